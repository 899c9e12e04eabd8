from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from closeline.constants import EARLY_GATE_STATES, EARLY_WEIGHT_STATES, STATES
from closeline.functions.dates import MonthOf
from closeline.plans import forecast as f
from closeline.sources.tables import publish_catalog_view, publish_table, publish_view

from .conftest import AS_OF, at_noon, frame, labels

D = dt.date
MONTH_END, DECEMBER = D(1998, 6, 30), D(1998, 12, 30)


def projection(n, **columns):
    row = {
        "table_type": "dynamic projections",
        "application_id": n,
        "loan_officer_name": "Officer A",
        "total_amount": Decimal("1000.00"),
        "state": "final_terms",
        "percent_close": Decimal("0.5000"),
        "product": "Bridge",
        "portfolio": False,
        "closing_status": "confirmed",
        "closing_status_date": AS_OF,
        "deal_stage_date": AS_OF,
        "dynamic_settlement_date": AS_OF,
    }
    return {**row, **columns}


@pytest.fixture
def flags(spark):
    def build(operator, as_of, rows):
        base = frame(spark, "projections", [projection(n, **r) for n, r in rows.items()])
        return labels(operator(f.forecast_base(base), as_of))

    return build


def test_month():
    june, december = MonthOf(AS_OF), MonthOf(DECEMBER)
    assert (june.start, june.end, june.days_left) == (D(1998, 6, 1), MONTH_END, 13)
    assert (december.next_start, december.days_left) == (D(1999, 1, 1), 1)


def test_base_keeps_one_row_type(spark):
    rows = [projection(1), projection(2, table_type="static"), projection(3, table_type=None)]
    assert [r["application_id"] for r in f.forecast_base(
        frame(spark, "projections", rows)).collect()] == [1]


def undated(stage, median, **more):
    return {
        "dynamic_settlement_date": None,
        "deal_stage_date": stage,
        "median_days_to_close": median,
        **more,
    }


def test_projection_rounds_half_days_away_from_zero(flags):
    rows = {
        1: undated(D(1998, 5, 30), 2.0),
        2: undated(D(1998, 5, 30), 1.5),
        3: undated(D(1998, 5, 30), 1.4),
        4: undated(D(1998, 6, 28), 2.4),
        5: undated(D(1998, 6, 28), 2.5),
        6: undated(None, 2.0),
        7: undated(D(1998, 6, 1), None),
    }
    expected = {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    assert flags(f.null_settlement_flag, AS_OF, rows) == expected


def test_long_term(flags):
    old, older = D(1998, 5, 4), D(1998, 5, 3)
    rows = {
        1: {"deal_stage_date": old},
        2: {"deal_stage_date": older},
        3: {"deal_stage_date": older, "portfolio": True},
        4: {"deal_stage_date": older, "portfolio": None},
        5: {"deal_stage_date": None},
    }
    expected = {1: False, 2: True, 3: False, 4: False, 5: False}
    assert flags(f.long_term_flag, AS_OF, rows) == expected


def test_date_range(flags):
    rows = {
        1: {"dynamic_settlement_date": D(1998, 6, 1)},
        2: {"dynamic_settlement_date": MONTH_END},
        3: {"dynamic_settlement_date": D(1998, 7, 1)},
        4: {"dynamic_settlement_date": D(1998, 5, 31)},
        5: undated(D(1998, 6, 10), 5.0),
        6: undated(D(1998, 6, 10), 30.0),
        7: undated(D(1998, 4, 20), 50.0),
        8: undated(D(1998, 4, 20), 50.0, portfolio=True),
    }
    expected = {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True}
    assert flags(f.date_range_flag, AS_OF, rows) == expected


def pending(product, age, median, as_of=AS_OF):
    name = f"median_days_from_unconfirmed_to_confirmed_{product.lower()}"
    return {
        "product": product,
        "closing_status": "not_confirmed",
        "closing_status_date": as_of - dt.timedelta(days=age),
        name: median,
    }


def test_closing_status(flags):
    rows = {
        1: {"closing_status": "confirmed"},
        2: {"closing_status": "likely"},
        3: {"closing_status": None},
        4: pending("Bridge", 10, 10.0),
        5: pending("Bridge", 11, 10.0),
        6: pending("Bridge", 3, 2.5),
        7: pending("Bridge", 2, 2.5),
        # 13 days are left; half a day more rounds up to 14.
        8: pending("Rental", 5, 13.0),
        9: pending("Rental", 5, 13.4),
        10: pending("Rental", 5, 13.5),
        11: {**pending("Bridge", 1, 5.0), "product": "Other"},
        12: {**pending("Bridge", 1, 5.0), "product": "Rental"},
    }
    true = {1, 2, 4, 7, 8, 9}
    assert flags(f.closing_status_flag, AS_OF, rows) == {n: n in true for n in rows}


def test_closing_status_on_the_last_day_admits_confirmed(flags):
    rows = {
        1: {"closing_status": "confirmed"},
        2: {"closing_status": "likely"},
        3: pending("Bridge", 1, 1.0, MONTH_END),
        4: pending("Bridge", 0, 0.0, MONTH_END),
    }
    expected = {1: True, 2: False, 3: False, 4: True}
    assert flags(f.closing_status_flag, MONTH_END, rows) == expected


def test_deal_stage(flags):
    def staged(state, product, bridge, rental):
        return {
            "state": state,
            "product": product,
            "median_days_to_close_after_final_terms_bridge": bridge,
            "median_days_to_close_after_final_terms_rental": rental,
        }

    rows = {
        1: staged("initial_terms", "Bridge", 13.0, 0.0),
        2: staged("initial_terms", "Bridge", 12.0, 99.0),
        3: staged("initial_terms", "Bridge", 12.5, 0.0),
        4: staged("initial_signed_term_sheet", "Rental", 0.0, 13.0),
        5: staged("final_terms", "Rental", 99.0, 99.0),
        6: staged("initial_terms", "Other", 99.0, 99.0),
        7: staged("initial_terms", "Bridge", None, 99.0),
        8: staged(None, "Bridge", 99.0, 99.0),
    }
    false = {1, 3, 4}
    assert flags(f.deal_stage_flag, AS_OF, rows) == {n: n not in false for n in rows}


@pytest.mark.parametrize("as_of", [MONTH_END, DECEMBER])
def test_deal_stage_late_states_always_can(flags, as_of):
    medians = {
        "median_days_to_close_after_final_terms_bridge": 5.0,
        "median_days_to_close_after_final_terms_rental": 5.0,
    }
    rows = {n: {"state": state, **medians} for n, state in enumerate(STATES)}
    found = flags(f.deal_stage_flag, as_of, rows)
    assert found == {n: s not in EARLY_GATE_STATES for n, s in enumerate(STATES)}


def loan(n, amount, **columns):
    row = {
        "id": 100 + n,
        "application_id": n,
        "total_amount": Decimal(amount),
        "settlement_date": AS_OF,
        "appraisal_paid_at": at_noon(AS_OF),
    }
    return {**row, **columns}


def app(n, officer=1, **columns):
    row = {
        "id": n,
        "state": "final_terms",
        "closing_status": "likely",
        "loan_officer_id": officer,
    }
    return {**row, **columns}


CONTACTS = [
    {"id": 1, "first_name": "Ann", "last_name": "Lee"},
    {"id": 2, "first_name": "Bob", "last_name": None},
]


@pytest.fixture
def calendar_tables(lending):
    return lending(
        contacts=CONTACTS,
        applications=[
            app(1),
            app(2),
            app(3, officer=2),
            app(4, officer=9),
            app(5, state="preliminary_review"),
            app(6, closing_status=None),
            app(7, withdrawn_at=at_noon(AS_OF)),
            app(8, rejection_status="rejected"),
            # Only the date of a rejection: still counted.
            app(9, rejected_at=at_noon(AS_OF)),
            app(10),
            app(11),
            app(12),
        ],
        loans=[
            loan(1, "100.10", settlement_date=D(1998, 6, 1)),
            loan(2, "200.20", settlement_date=MONTH_END),
            *[loan(n, "1000.00") for n in range(3, 10)],
            loan(10, "1000.00", settlement_date=D(1998, 7, 1)),
            loan(11, "1000.00", appraisal_paid_at=None),
            loan(12, "1000.00"),
        ],
        # Loan 102 has two cost rows, loan 112 none.
        loan_closing_costs=[{"loan_id": n} for n in (101, 102, 102, *range(103, 112))],
    )


@pytest.mark.parametrize("dedupe, ann", [(False, "1500.50"), (True, "1300.30")])
def test_closing_calendar(calendar_tables, dedupe, ann):
    found = f.closing_calendar(calendar_tables, AS_OF, dedupe_costs=dedupe)
    assert sorted(map(tuple, found.collect())) == [
        (1, "Ann Lee", Decimal(ann)),
        (2, None, Decimal("1000.00")),
    ]


def forecast_rows():
    rows = [projection(1)]
    rows += [projection(2, loan_officer_name=None), projection(3, loan_officer_name="Out")]
    rows += [projection(4, department="retail"), projection(5, department="tpo")]
    rows += [projection(6, department="wholesale")]
    rows += [projection(7, dynamic_settlement_date=D(1998, 7, 1))]
    rows += [projection(8, table_type="static")]
    rows += [projection(9, closing_status=None)]
    # Early for the stage gate only: full weight; and early for both.
    rows += [projection(10, state="initial_terms"), projection(11, state="lead")]
    # Not among the applications: no officer id.
    rows += [projection(12, loan_officer_name="Officer B")]
    rows += [projection(None)]
    return rows


@pytest.fixture
def forecast_tables(lending):
    return lending(
        projections=forecast_rows(),
        applications=[app(n) for n in range(1, 12)],
        contacts=CONTACTS,
        loans=[loan(1, "100.00")],
        loan_closing_costs=[{"loan_id": 101}, {"loan_id": 101}],
    )


@pytest.mark.parametrize("unique", [True, False])
def test_forecast(forecast_tables, unique):
    found = f.loan_officer_monthly_forecast(
        forecast_tables, AS_OF, excluded_officers=["Out"], unique_applications=unique
    )
    # 1, 4, 5 and 10 at half, 11 at a tenth of 1000.
    assert sorted(map(tuple, found.collect())) == [
        ("Officer A", Decimal("200.00"), 1, Decimal("2100.000000")),
        ("Officer B", None, None, Decimal("500.000000")),
    ]


def test_no_officer_is_excluded_by_default(forecast_tables):
    names = {r[0] for r in f.loan_officer_monthly_forecast(forecast_tables, AS_OF).collect()}
    assert names == {"Officer A", "Officer B", "Out"}


def test_seven_early_states_weigh_a_tenth(lending):
    tables = lending(
        projections=[projection(n, state=s) for n, s in enumerate(EARLY_WEIGHT_STATES)]
    )
    (row,) = f.loan_officer_monthly_forecast(tables, AS_OF).collect()
    assert row["forecast_amount"] == Decimal("700.000000")


def test_calendar_amount_is_a_group_key(lending):
    tables = lending(
        projections=[projection(1), projection(2)],
        applications=[app(1), app(2)],
        contacts=[*CONTACTS, {"id": 1, "first_name": "Ann", "last_name": "Ley"}],
        loans=[loan(1, "100.00")],
        loan_closing_costs=[{"loan_id": 101}],
    )
    # Two names of one officer carry the same amount and fall into one group.
    (row,) = f.loan_officer_monthly_forecast(tables, AS_OF).collect()
    assert (row[1], row[3]) == (Decimal("100.00"), Decimal("2000.000000"))


def test_repeated_applications_share_their_flags(lending):
    june, july = D(1998, 6, 20), D(1998, 7, 20)
    tables = lending(
        projections=[
            # Neither row passes on its own, together they do: both rows count.
            projection(1, dynamic_settlement_date=june, closing_status=None),
            projection(1, dynamic_settlement_date=july, total_amount=Decimal("10.00")),
            # Exact repeats count once.
            projection(2),
            projection(2),
        ],
        applications=[app(1), app(2)],
    )
    (row,) = f.loan_officer_monthly_forecast(tables, AS_OF).collect()
    assert row["forecast_amount"] == Decimal("1005.000000")
    enriched = f.forecast_enriched(tables["projections"], tables["applications"], AS_OF)
    assert enriched.count() == 2 * 2 * 2 + 1


def test_enriched_without_application_id_has_no_flags(lending):
    tables = lending(projections=[projection(None)])
    for unique in (True, False):
        (row,) = f.forecast_enriched(
            tables["projections"], tables["applications"], AS_OF, unique_applications=unique
        ).collect()
        assert (row["date_range"], row["status_flag"], row["stage_flag"]) == (None,) * 3


def test_totals_do_not_depend_on_partitioning(lending):
    rows = [
        projection(n, total_amount=Decimal(n) / 100, percent_close=Decimal("0.3333"))
        for n in range(1, 200)
    ]
    totals = set()
    for parts, ordered in ((1, rows), (7, rows[::-1])):
        tables = dict(lending(projections=ordered, applications=[app(n) for n in range(200)]))
        tables["projections"] = tables["projections"].repartition(parts)
        (row,) = f.loan_officer_monthly_forecast(tables, AS_OF).collect()
        totals.add(row["forecast_amount"])
    assert len(totals) == 1


def test_publish(spark, forecast_tables, tmp_path):
    df = f.loan_officer_monthly_forecast(forecast_tables, AS_OF)
    view = publish_view(df, "officer_forecast")
    assert view.columns == df.columns
    assert spark.sql("SELECT count(*) FROM officer_forecast").first()[0] == 3
    publish_view(df.limit(0), "officer_forecast")
    assert spark.table("officer_forecast").count() == 0


def test_publish_table(spark, forecast_tables, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS reports LOCATION '{tmp_path}'")
    df = f.loan_officer_monthly_forecast(forecast_tables, AS_OF)
    for _ in range(2):
        assert publish_table(df, "reports.officer_forecast").count() == 3
    spark.sql("DROP DATABASE reports CASCADE")


def test_a_catalog_view_is_seen_by_other_sessions(spark, forecast_tables, tmp_path):
    spark.sql(f"CREATE DATABASE lending LOCATION '{tmp_path}'")
    try:
        names = {}
        for table in ("projections", "applications", "loans", "loan_closing_costs", "contacts"):
            names[table] = f"lending.{table}"
            forecast_tables[table].write.saveAsTable(names[table])
        excluded = ["Officer A", "O'Brien \\ Sons"]
        for officers in ((), excluded):
            query = f.monthly_forecast_sql(names, AS_OF, excluded_officers=officers)
            columns = [f"{c}_shown" for c in f.FORECAST_COLUMNS]
            publish_catalog_view(spark, "lending.forecast", columns, query)
            other = spark.newSession().table("lending.forecast")
            assert other.columns == columns
            want = f.loan_officer_monthly_forecast(forecast_tables, AS_OF, excluded_officers=officers)
            assert tuple(want.columns) == f.FORECAST_COLUMNS
            assert sorted(map(repr, map(tuple, other.collect()))) == sorted(
                map(repr, map(tuple, want.collect()))
            )
        # The view reads the tables anew.
        spark.sql("TRUNCATE TABLE lending.projections")
        assert spark.newSession().table("lending.forecast").count() == 0
    finally:
        spark.sql("DROP DATABASE lending CASCADE")


def test_date_range_of_repeated_applications(lending):
    """Rows meet the projections and ages of all rows of their application, with repeats."""
    rows = [projection(1), projection(1, **undated(AS_OF, 1)), projection(1, **undated(D(1998, 1, 1), 3))]
    rows += [projection(2, **undated(D(1998, 1, 1), 400)), projection(2, **undated(AS_OF, 400))]
    rows += [projection(3, dynamic_settlement_date=D(1999, 1, 1))]
    rows += [projection(None), projection(None), projection(None, **undated(AS_OF, 1))]
    base = f.forecast_base(lending(projections=rows)["projections"])
    facts = f.null_settlement_flag(base, AS_OF).selectExpr("application_id", "null_settlement_date AS n")
    ages = f.long_term_flag(base, AS_OF).selectExpr("application_id", "long_term_deals AS d")
    met = base.join(facts, "application_id", "left").join(ages, "application_id", "left")
    settles = f"coalesce({f.settles_in_month(AS_OF)}, false)"
    want = met.selectExpr("application_id", f"{settles} OR ({f.UNDATED} AND coalesce(n AND NOT d, false)) AS date_range")
    found = f.date_range_flag(base, AS_OF)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert found.count() == 27 + 8 + 1 + 3

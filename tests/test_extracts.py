from __future__ import annotations

import datetime as dt

import pytest

from closeline.operators import extracts

from .conftest import at_noon, labels

D = dt.date
JUNE = [at_noon(D(1998, 6, n)) for n in range(1, 31)]


def follow_up(loan_id, date, via, kind="title"):
    return {"loan_id": loan_id, "date": date, "via": via, "type": kind}


FOLLOW_UPS = [
    follow_up(1, JUNE[0], "email"),
    follow_up(1, JUNE[4], "PHONE"),
    # Equal dates: the greatest text wins, no text loses.
    follow_up(2, JUNE[4], "email"),
    follow_up(2, JUNE[4], "text"),
    follow_up(2, JUNE[4], None),
    # A missing date counts as the newest.
    follow_up(3, JUNE[9], "email"),
    follow_up(3, None, "text"),
    # Only the other kind.
    follow_up(4, JUNE[1], "email", "borrower"),
    follow_up(1, JUNE[20], "text", "borrower"),
    follow_up(1, JUNE[21], "text", "other"),
]


def test_latest_follow_up(lending):
    follow_ups = lending(loan_follow_ups=FOLLOW_UPS)["loan_follow_ups"]
    found = extracts.latest_follow_up(follow_ups, "title")
    assert found.columns == ["loan_id", "date", "via", "row_num"]
    assert sorted(map(tuple, found.collect())) == [
        (1, JUNE[4], "PHONE", 1),
        (2, JUNE[4], "text", 1),
        (3, None, "text", 1),
    ]


def test_both_kinds_in_one_pass(lending):
    follow_ups = lending(loan_follow_ups=FOLLOW_UPS)["loan_follow_ups"]
    found = {r["loan_id"]: tuple(r)[1:] for r in extracts.latest_follow_ups(follow_ups).collect()}
    assert found == {
        1: (JUNE[4], "PHONE", JUNE[20], "text"),
        2: (JUNE[4], "text", None, None),
        3: (None, "text", None, None),
        4: (None, None, JUNE[1], "email"),
    }


def test_hashed_follow_ups_are_the_sorted_ones(spark):
    """Dates over all years, on the microsecond, in gaps of daylight saving, and none."""
    dates = [
        "0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00",
        "2024-03-31 02:30:00.000001", "2024-03-31 03:30:00", "9999-12-31 23:59:59.999999", None,
    ]
    vias = ["", "A", "a", "z", "\uffee", "\U0001f600", None]
    rows = [(d, v) for d in dates for v in vias]
    rows = [(n * 10 + i % 4, *rows[i], t) for n, t in enumerate(("title", "borrower", "x")) for i in range(len(rows))]
    rows += [(100 + i, d, v, "title") for i, (d, v) in enumerate((d, v) for d in dates for v in vias)]
    plain = spark.createDataFrame(rows, "loan_id long, date string, via string, type string")
    follow_ups = plain.withColumn("date", plain.date.cast("timestamp_ntz"))
    known = extracts.via_values(follow_ups)
    assert known == ["", "A", "a", "z", "\uffee", "\U0001f600"]
    for build in (
        lambda vias: extracts.latest_follow_up(follow_ups, "title", vias),
        lambda vias: extracts.latest_follow_ups(follow_ups, vias),
    ):
        hashed, sorting = build(known), build(None)
        assert hashed.schema.simpleString() == sorting.schema.simpleString()
        assert sorted(map(str, hashed.collect())) == sorted(map(str, sorting.collect()))
        text = hashed._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in text and "HashAggregate" in text
    none = extracts.latest_follow_up(follow_ups.limit(0), "title", [])
    assert none.count() == 0 and extracts.via_values(follow_ups.limit(0)) == []
    many = spark.range(32).selectExpr("CAST(id AS string) AS via")
    assert extracts.via_values(many) is None
    with pytest.raises(Exception, match="via is not in vias"):
        extracts.latest_follow_up(follow_ups, "title", ["a"]).collect()


def test_initial_terms_date(lending):
    sheet = "TermSheet::InitialTerms"
    tables = lending(
        applications=[{"id": n} for n in (1, 2, 3, 4)],
        term_sheets=[
            {"application_id": 1, "created_at": JUNE[9], "type": sheet},
            {"application_id": 1, "created_at": JUNE[3], "type": sheet},
            {"application_id": 1, "created_at": JUNE[0], "type": "TermSheet::FinalTerms"},
            {"application_id": 2, "created_at": JUNE[0], "type": "TermSheet::FinalTerms"},
            {"application_id": 4, "created_at": None, "type": sheet},
            {"application_id": 9, "created_at": JUNE[0], "type": sheet},
        ],
    )
    found = extracts.initial_terms_date(tables["applications"], tables["term_sheets"])
    assert labels(found) == {1: D(1998, 6, 4), 4: None}


def review_tables(lending):
    apps = [{"id": n, "state": "preliminary_review"} for n in range(1, 9)]
    apps[5]["withdrawn_at"] = JUNE[0]
    apps[6]["rejected_at"] = JUNE[0]
    apps[7]["long_termed_at"] = JUNE[0]
    apps.append({"id": 9, "state": "initial_terms"})
    channel = [{"application_id": n, "ops_channel": "Retail"} for n in (1, 2, 3, 6, 7, 8, 9)]
    return lending(
        applications=apps,
        deal_product_channel=channel
        + [
            # A second row of the same channel must not repeat the application.
            {"application_id": 1, "ops_channel": "Retail"},
            {"application_id": 4, "ops_channel": "Private Client Group"},
            {"application_id": 5, "ops_channel": None},
        ],
        deal_stage_dates=[
            {"application_id": n, "preliminary_review_date": d}
            for n, d in ((1, JUNE[1]), (2, None), (4, JUNE[2]), (5, JUNE[2]), (9, JUNE[2]))
        ],
        deal_stage_time_stamps=[
            {"application_id": n, "preliminary_review_date": JUNE[10]} for n in (1, 2)
        ],
    )


def test_preliminary_review_dates(lending):
    tables = review_tables(lending)
    assert labels(extracts.prelim_review_primary(tables)) == {1: JUNE[1], 2: None, 3: None}
    assert labels(extracts.prelim_review_fallback(tables)) == {2: JUNE[10], 3: None}
    assert labels(extracts.prelim_review_date(tables)) == {1: JUNE[1], 2: JUNE[10], 3: None}

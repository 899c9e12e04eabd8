"""Ids of few applications thin the tables below them before anything is shuffled."""

from __future__ import annotations


import pytest

from closeline.operators import kpis as k
from closeline.operators import reducers
from closeline.plans import report

from .conftest import at_noon, day
from .test_plans import input_rows


@pytest.fixture
def tables(lending):
    """Sixty applications, of which three have been submitted in a state the closing rule covers."""
    applications = [
        {
            "id": n,
            "state": "final_terms" if n % 20 == 0 else "closed",
            "submitted_to_initial_underwriting_at": at_noon(day(-5)),
        }
        for n in range(60)
    ]
    loans = [{"id": 100 * n + i, "application_id": n} for n in range(60) for i in range(4)]
    return lending(
        applications=applications,
        loans=[*loans, {"id": 1, "application_id": None}],
        loan_follow_ups=[
            {"loan_id": x["id"], "type": "title", "date": at_noon(day(-1))} for x in loans for _ in range(3)
        ],
        legal_closing_informations=[{"application_id": n} for n in range(60)],
        properties=[{"id": 7 * x["id"], "loan_id": x["id"]} for x in loans],
        property_valuations=[{"property_id": 7 * x["id"]} for x in loans],
    )


KPIS = [k.CLOSING, k.TITLE_ORDER_CONFIRMATION, k.APPRAISAL_MISSING, k.TITLE_ORDER]


@pytest.mark.parametrize("kpi", KPIS, ids=lambda kpi: kpi.name)
@pytest.mark.parametrize("most", [1, 3, 12, 1000])
def test_results_are_the_same_whatever_is_sent_down(tables, clock, kpi, most):
    for grain in ("row", "application"):
        plain = k.classify(tables, clock(), kpi, grain).collect()
        found = k.classify(tables, clock(), kpi, grain, reduce_up_to=most).collect()
        assert plain and sorted(map(str, found)) == sorted(map(str, plain))


def test_no_other_child_row_reaches_a_shuffle(spark, tables, clock):
    df = k.classify(tables, clock(), k.TITLE_ORDER_CONFIRMATION, reduce_up_to=1000)
    # Three applications with four loans of three follow-ups each.
    assert input_rows(spark, df, "partial_max(date") == 36
    assert input_rows(spark, df, "loan_facts#") <= 12
    plain = k.classify(tables, clock(), k.TITLE_ORDER_CONFIRMATION)
    assert input_rows(spark, plain, "partial_max(date") == 720


def test_ids_stop_where_they_are_too_many(tables):
    apps = tables["applications"].filter("state = 'final_terms'")
    apps = apps.withColumnRenamed("id", "application_id")
    names = ("loans", "loan_follow_ups", "property_valuations")

    def counts(most):
        thin = reducers.reduced(tables, apps, most, *names)
        assert len(thin) == len(tables) and set(thin) == set(tables)
        return tuple(thin[n].count() for n in names)

    whole = (241, 720, 240)
    assert counts(2) == whole
    assert counts(3) == (12, *whole[1:])
    assert counts(12) == (12, 36, 12)


def test_the_report_is_the_same(tables, clock):
    plain = report.application_report(tables, clock()).collect()
    found = report.application_report(tables, clock(), reduce_up_to=1000).collect()
    assert sorted(map(str, found)) == sorted(map(str, plain))

"""Registered queries against independent SQL."""

from __future__ import annotations

import datetime as dt
import re

import pytest

import __spark_entry__ as entry
from closeline.operators import kpis
from closeline.plans import forecast, report
from closeline.sources.testdata import StarSchema
from oracle.queries import FORECAST, Oracle

from .compare import assert_same, connect
from .conftest import SF_DIR

# The optional corpus queries have tests of their own.
CORPUS = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: q for k, q in entry.queries().items() if not CORPUS.match(k)}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if not CORPUS.match(k)}

# A Wednesday early in the month, a Saturday, the last day, the end of a year.
DAYS = [dt.date(1998, 6, 10), dt.date(1998, 6, 20), dt.date(1998, 6, 30), dt.date(1998, 12, 30)]

@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert assert_same(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert tuple(df.columns) == report.REPORT_COLUMNS
    assert df.count() > 0


@pytest.mark.parametrize("as_of", DAYS, ids=str)
def test_report_on_other_days(spark, con, as_of):
    star = StarSchema(spark, SF_DIR)
    df = report.application_report(star.tables(), star.clock(as_of))
    assert_same(df, con, Oracle(as_of).sql("SELECT * FROM report"))


@pytest.mark.parametrize("as_of", DAYS, ids=str)
def test_forecast_on_other_days(spark, con, as_of):
    df = forecast.loan_officer_monthly_forecast(
        StarSchema(spark, SF_DIR).tables(), as_of, excluded_officers=entry.EXCLUDED_OFFICERS
    )
    df = entry.money(df, "closing_calendar_amount", "forecast_amount")
    assert_same(df, con, Oracle(as_of).sql(FORECAST))


@pytest.mark.parametrize("as_of", DAYS, ids=str)
def test_flags_on_other_days(spark, con, as_of):
    base = forecast.forecast_base(StarSchema(spark, SF_DIR).tables()["projections"])
    oracle = Oracle(as_of)
    for operator, relation in (
        (forecast.date_range_flag, "in_range"),
        (forecast.closing_status_flag, "status_flags"),
        (forecast.deal_stage_flag, "stage_flags"),
    ):
        assert_same(operator(base, as_of), con, oracle.sql(f"SELECT * FROM {relation}"))


@pytest.mark.parametrize("key", ["closing_kpi", "title_follow_up_kpi", "cda_kpi"])
def test_rows_with_several_loans(spark, con, key):
    from oracle.queries import KPI_KEYS

    star = StarSchema(spark, SF_DIR, second_loans=True)
    df = kpis.classify(star.tables(), star.clock(), entry.KPI_KEYS[key])
    sql = Oracle(entry.AS_OF, second_loans=True).sql(f"SELECT * FROM {KPI_KEYS[key]}")
    assert_same(df, con, sql)

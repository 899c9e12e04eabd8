from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from closeline.constants import AHEAD_OFFSETS, BACK_OFFSETS
from closeline.operators import calendar as cal

from .conftest import AS_OF, MEMORIAL_DAY, frame

D = dt.date


def days_of(df):
    return sorted(r[0] for r in df.collect())


def test_default_series_is_100000_days_from_2023(spark):
    row = cal.date_series(spark).agg(
        F.min("date_value"), F.max("date_value"), F.countDistinct("date_value")
    )
    assert tuple(row.first()) == (D(2023, 1, 1), D(2296, 10, 15), 100_000)


@pytest.mark.parametrize("days", [0, -1])
def test_series_length_is_positive(spark, days):
    with pytest.raises(ValueError):
        cal.date_series(spark, days=days)


def test_spanning_series_covers_first_to_last(spark):
    dates = spark.createDataFrame([(D(1998, 2, 27),), (D(1998, 3, 2),), (None,)], "d date")
    found = days_of(cal.date_series_spanning(dates))
    assert found == [D(1998, 2, 27), D(1998, 2, 28), D(1998, 3, 1), D(1998, 3, 2)]


@pytest.fixture
def holidays(spark):
    rows = MEMORIAL_DAY + [
        # Not one of the named holidays: stays a business day.
        {"holiday_date": D(1998, 6, 15), "name": "Flag Day"},
        {"holiday_date": D(1998, 6, 16), "name": None},
    ]
    return frame(spark, "holidays", rows)


@pytest.fixture
def bank_holidays(spark):
    rows = [
        {"holiday_date": D(1998, 10, 12), "holiday_name": "Columbus Day"},
        {"holiday_date": D(1998, 11, 11), "holiday_name": "Veterans Day"},
        {"holiday_date": D(1998, 11, 11), "holiday_name": "Veterans Day"},
        {"holiday_date": D(1998, 11, 12), "holiday_name": "Another Day"},
    ]
    return frame(spark, "bank_holidays", rows)


def test_business_days_drop_weekends_and_named_holidays(spark, holidays):
    found = days_of(cal.business_days(cal.date_series(spark, "1998-05-21", 7), holidays))
    assert found == [D(1998, 5, 21), D(1998, 5, 22), D(1998, 5, 26), D(1998, 5, 27)]
    found = days_of(cal.business_days(cal.date_series(spark, "1998-06-15", 2), holidays))
    assert found == [D(1998, 6, 15), D(1998, 6, 16)]


def test_bank_holidays_stay_business_days_once(spark, holidays, bank_holidays):
    series = cal.date_series(spark, "1998-11-09", 5)
    kept = days_of(cal.business_days(series, holidays, bank_holidays))
    assert kept == [D(1998, 11, n) for n in (9, 10, 11, 12, 13)]
    dropped = cal.business_days(series, holidays, bank_holidays, exclude_bank_holidays=True)
    assert days_of(dropped) == [D(1998, 11, n) for n in (9, 10, 12, 13)]


def test_excluding_bank_holidays_needs_them(spark, holidays):
    with pytest.raises(ValueError):
        cal.business_days(cal.date_series(spark), holidays, exclude_bank_holidays=True)


def test_offsets_are_neighbours_and_inverse(spark, holidays):
    days = cal.business_days(cal.date_series(spark, "1998-01-01", 365), holidays)
    ordered = days_of(days)
    rows = {r["dateframe"]: r for r in cal.business_day_offsets(days).collect()}
    assert list(sorted(rows)) == ordered
    for i, date in enumerate(ordered):
        for k in BACK_OFFSETS:
            assert rows[date][f"neg_{k}"] == (ordered[i - k] if i >= k else None)
        for k in AHEAD_OFFSETS:
            inside = i + k < len(ordered)
            assert rows[date][f"pos_{k}"] == (ordered[i + k] if inside else None)
            if inside and k in BACK_OFFSETS:
                assert rows[rows[date][f"pos_{k}"]][f"neg_{k}"] == date


@pytest.mark.parametrize("as_of", [AS_OF, D(1998, 5, 26), D(1998, 1, 5), D(1998, 12, 31)])
def test_as_of_offsets_equal_the_window(spark, holidays, as_of):
    days = cal.business_days(cal.date_series(spark, "1998-01-01", 365), holidays)
    expected = cal.business_day_offsets(days).filter(F.col("dateframe") == as_of).collect()
    assert cal.as_of_offsets(days, as_of).collect() == expected


@pytest.mark.parametrize("outside", [D(1997, 12, 31), D(1999, 1, 1)])
def test_a_day_outside_the_calendar_raises(spark, holidays, outside):
    days = cal.business_days(cal.date_series(spark, "1998-01-01", 365), holidays)
    with pytest.raises(Exception, match="outside the business days"):
        cal.as_of_offsets(days, outside).collect()
    assert cal.as_of_offsets(days, D(1998, 6, 20)).collect() == []


@pytest.mark.parametrize("closed", [D(1998, 6, 20), D(1998, 5, 25)])
def test_as_of_calendar_is_empty_on_closed_days(spark, lending, clock, closed):
    apps = lending(applications=[{"id": 1}, {"id": 2}])["applications"]
    assert cal.as_of_calendar(apps, clock(closed)).count() == 0


def test_as_of_calendar_repeats_the_row_per_application(lending, clock):
    apps = lending(applications=[{"id": 1}, {"id": 2}, {"id": 2}])["applications"]
    rows = cal.as_of_calendar(apps, clock()).collect()
    assert sorted(r["application_id"] for r in rows) == [1, 2]
    assert {(r["dateframe"], r["neg_3"], r["pos_10"]) for r in rows} == {
        (AS_OF, D(1998, 6, 12), D(1998, 7, 1))
    }

"""Business calendar: day series, business days, offsets, as-of clock.

The calendar is the only part of the library that is ordered globally.  Its size
is the number of days asked for (100,000 by default), never a function of the lending tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closeline.constants import (
    AHEAD_OFFSETS,
    BACK_OFFSETS,
    BANK_HOLIDAY_NAMES,
    CALENDAR_DAYS,
    CALENDAR_START,
    HOLIDAY_NAMES,
)

OFFSET_COLUMNS = [f"neg_{k}" for k in BACK_OFFSETS] + [f"pos_{k}" for k in AHEAD_OFFSETS]


def date_series(
    spark: SparkSession,
    start: dt.date | str = CALENDAR_START,
    days: int = CALENDAR_DAYS,
) -> DataFrame:
    """`days` consecutive days from `start`: (date_value)."""
    if days <= 0:
        raise ValueError(f"a calendar holds 1 day or more, not {days}")
    first = F.lit(str(start)).cast("date")
    return spark.range(0, days, 1, 1).select(
        F.date_add(first, F.col("id").cast("int")).alias("date_value")
    )


def date_series_spanning(dates: DataFrame) -> DataFrame:
    """Every day from the first to the last date in the one column of `dates`."""
    (column,) = dates.columns
    day = F.to_date(F.col(column))
    bounds = dates.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("date_value"))


def business_days(
    series: DataFrame,
    holidays: DataFrame,
    bank_holidays: DataFrame | None = None,
    *,
    exclude_bank_holidays: bool = False,
    holiday_names: Sequence[str] = HOLIDAY_NAMES,
    bank_holiday_names: Sequence[str] = BANK_HOLIDAY_NAMES,
) -> DataFrame:
    """Weekdays that are none of the named holidays: (dateframe).

    Bank holidays stay business days unless `exclude_bank_holidays` is set.
    """
    day = F.to_date("date_value")
    weekdays = series.select(day.alias("dateframe")).filter(
        ~F.dayofweek("dateframe").isin(1, 7)
    )
    closed = holidays.filter(F.col("name").isin(*holiday_names)).select(
        F.to_date("holiday_date").alias("dateframe")
    )
    if exclude_bank_holidays:
        if bank_holidays is None:
            raise ValueError("exclude_bank_holidays needs the bank holiday table")
        closed = closed.unionByName(
            bank_holidays.filter(F.col("holiday_name").isin(*bank_holiday_names)).select(
                F.to_date("holiday_date").alias("dateframe")
            )
        )
    return weekdays.join(closed, "dateframe", "left_anti")


def business_day_offsets(days: DataFrame) -> DataFrame:
    """Per business day its k-th neighbours: (dateframe, neg_k..., pos_k...)."""
    by_day = "OVER (ORDER BY dateframe)"
    return days.selectExpr(
        "dateframe",
        *[f"lag(dateframe, {k}) {by_day} AS neg_{k}" for k in BACK_OFFSETS],
        *[f"lead(dateframe, {k}) {by_day} AS pos_{k}" for k in AHEAD_OFFSETS],
    )


def as_of_offsets(days: DataFrame, as_of: dt.date) -> DataFrame:
    """The offsets row of one day, or no row when it is not a business day.

    Same row as `business_day_offsets(days)` filtered to `as_of`, from the nearest
    days on either side only.  A day before the first or after the last of `days`
    raises: without neighbours it could not be told from a weekend.
    """
    now = f"DATE '{as_of}'"
    back, ahead = max(BACK_OFFSETS), max(AHEAD_OFFSETS)
    until = days.filter(f"dateframe <= {now}").orderBy(F.desc("dateframe")).limit(back + 1)
    after = days.filter(f"dateframe > {now}").orderBy("dateframe").limit(ahead)
    split = until.unionByName(after).agg(
        F.expr(f"bool_or(dateframe = {now}) AS open"),
        F.expr(f"sort_array(collect_list(IF(dateframe < {now}, dateframe, NULL)), false) AS past"),
        F.expr(f"sort_array(collect_list(IF(dateframe > {now}, dateframe, NULL))) AS coming"),
    )
    outside = f"raise_error('{as_of} lies outside the business days of the calendar')"
    is_open = (
        "CASE WHEN open THEN true WHEN size(past) > 0 AND size(coming) > 0 THEN false "
        f"ELSE CAST({outside} AS boolean) END"
    )
    return split.filter(is_open).selectExpr(
        f"{now} AS dateframe",
        *[f"get(past, {k - 1}) AS neg_{k}" for k in BACK_OFFSETS],
        *[f"get(coming, {k - 1}) AS pos_{k}" for k in AHEAD_OFFSETS],
    )


class Clock:
    """The moment a query is evaluated for, and the business days around it.

    The offsets enter a plan as one scalar subquery: computed once, used as a
    constant, NULL when the as-of day is no business day.  So the calendar is
    never joined and every comparison with it fails on a weekend or holiday.
    """

    COLUMN = "_business_days"

    def __init__(
        self, days: DataFrame, as_of: dt.date, as_of_ts: dt.datetime | None = None
    ) -> None:
        self.day = as_of
        self.moment = as_of_ts or dt.datetime.combine(as_of, dt.time())
        self.offsets = as_of_offsets(days, as_of)

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the offsets to `df`.  Do this after the last shuffle."""
        row = f"struct({', '.join(['dateframe', *OFFSET_COLUMNS])}) AS offsets"
        return df.withColumn(self.COLUMN, self.offsets.selectExpr(row).scalar())

    # SQL text of the moment and its neighbours, for rules on an attached frame.

    @property
    def as_of(self) -> str:
        return f"DATE '{self.day}'"

    @property
    def as_of_ts(self) -> str:
        return f"TIMESTAMP_NTZ '{self.moment}'"

    def back(self, k: int) -> str:
        return f"{self.COLUMN}.neg_{k}"

    def ahead(self, k: int) -> str:
        return f"{self.COLUMN}.pos_{k}"


def as_of_calendar(applications: DataFrame, clock: Clock) -> DataFrame:
    """The as-of offsets row on every application; empty on a non-business day."""
    ids = applications.selectExpr("id AS application_id").distinct()
    on_business_days = clock.attach(ids).filter(f"{Clock.COLUMN} IS NOT NULL")
    return on_business_days.select(f"{Clock.COLUMN}.*", "application_id")

from __future__ import annotations

import datetime as dt
import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from closeline.operators.calendar import Clock, business_days, date_series
from closeline.session import configured
from closeline.sources.schemas import SCHEMAS, columns_of
from closeline.sources.tables import LendingTables, from_frames

AS_OF = dt.date(1998, 6, 17)
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        configured(SparkSession.builder)
        .master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """A lending table from partial rows; what is left out is NULL."""
    names = columns_of(table)
    unknown = {k for row in rows for k in row} - set(names)
    assert not unknown, f"{table} has no columns {unknown}"
    schema = to_arrow_schema(StructType.fromDDL(SCHEMAS[table]))
    rows = [{n: r.get(n) for n in names} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


@pytest.fixture
def lending(spark):
    """Build lending tables; tables left out are empty."""

    def build(**tables: list[dict]) -> LendingTables:
        named = {n: frame(spark, n, tables.get(n, [])) for n in SCHEMAS if SCHEMAS[n]}
        named["deal_stage_stats"] = spark.range(0)
        return from_frames(named)

    return build


MEMORIAL_DAY = [{"holiday_date": dt.date(1998, 5, 25), "name": "Memorial Day"}]


@pytest.fixture
def clock(spark):
    """A clock over 1997-1999 with Memorial Day 1998 as the only holiday."""

    def build(as_of: dt.date = AS_OF, time: dt.time = dt.time(12, 30)) -> Clock:
        series = date_series(spark, "1997-01-01", 1000)
        days = business_days(series, frame(spark, "holidays", MEMORIAL_DAY))
        return Clock(days, as_of, dt.datetime.combine(as_of, time))

    return build


def day(k: int, as_of: dt.date = AS_OF) -> dt.date:
    """The k-th business day from `as_of`; Memorial Day 1998 is off."""
    step = 1 if k > 0 else -1
    date = as_of
    while k:
        date += dt.timedelta(days=step)
        if date.weekday() < 5 and date != dt.date(1998, 5, 25):
            k -= step
    return date


def at_noon(date: dt.date) -> dt.datetime:
    return dt.datetime.combine(date, dt.time(12))


def labels(df: DataFrame) -> dict:
    """First column to second, which must be unique."""
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1] for r in rows}

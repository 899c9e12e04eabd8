"""Order-insensitive comparison of a Spark result with DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def bag(columns: list[str], rows: list) -> Counter:
    """Rows as a multiset, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def spark_bag(df: DataFrame) -> Counter:
    return bag(df.columns, [tuple(row) for row in df.collect()])


def duckdb_bag(con: duckdb.DuckDBPyConnection, sql: str) -> Counter:
    cursor = con.execute(sql)
    return bag([c[0] for c in cursor.description], cursor.fetchall())


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Check names and rows; the number of rows."""
    names = [c[0] for c in con.execute(f"DESCRIBE ({sql})").fetchall()]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = spark_bag(df), duckdb_bag(con, sql)
    extra, missing = ours - theirs, theirs - ours
    assert not extra and not missing, (
        f"{sum(extra.values())} rows only in Spark, {sum(missing.values())} only in SQL; "
        f"e.g. {list(extra)[:2]} / {list(missing)[:2]}"
    )
    return sum(ours.values())

"""Equal rows as one row and their number.

Rows of one application that a rule cannot tell apart travel as one row and their
number: combined map-side, so that no hot key reaches a join.  Tables that meet on
an application multiply their numbers into `COPIES`, so that a pair of a record of
one with a record of another is never built before it is spelt out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES = "copies"
COPY_BLOCK = 1 << 16


def copies_of(mask: str) -> str:
    """Name of the number of child rows that have the facts in `mask`."""
    return f"{mask}_{COPIES}"


def counted(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """Rows of a key with equal facts as one row and their number."""
    return rows.groupBy(key, mask).agg(F.count("*").alias(copies_of(mask)))


def with_copies(df: DataFrame, masks: Iterable[str]) -> DataFrame:
    """Multiply the numbers of child rows into `COPIES`; a missing child counts once."""
    numbers = [f"coalesce({copies_of(mask)}, 1L)" for mask in masks]
    return df.withColumn(COPIES, F.expr(" * ".join(numbers))).drop(*map(copies_of, masks))


def spelt_out(df: DataFrame, key: str) -> DataFrame:
    """Each row as often as its `COPIES` says; once without one.

    Many copies of a row are dealt out in blocks, so one task spells out no more than
    a few blocks of any key.
    """
    columns = [c for c in df.columns if c != COPIES]
    last = f"CAST((coalesce({COPIES}, 1L) - 1) DIV {COPY_BLOCK} AS bigint)"
    blocks = df.selectExpr("*", f"explode(sequence(0L, {last})) AS block")
    rest = f"coalesce({COPIES}, 1L) - block * {COPY_BLOCK}"
    size = f"least({rest}, {COPY_BLOCK}L)"
    dealt = blocks.repartition(key, "block")
    return dealt.selectExpr(*columns, f"explode(sequence(1L, {size})) AS copy").drop("copy")

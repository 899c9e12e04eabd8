"""Places of rows in the order of their group, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, joined

#: Rows of one partition of the ranges; a row's place in its partition takes the lower bits of its number.
PLACE_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], then: list[str] | None = None) -> DataFrame:
    """`rows` with `place`, their number from 0 in the order of their `group`, and `n_rows` of the group.

    Rows are dealt by ranges of group and `order` and sorted in each partition (by `then` as
    well, columns too wide to set ranges by), nulls first.  Rows that are equal in all of them
    may be a third of the table: the order in which they were read deals them over several
    ranges.  Only one count for each group and range is summed over ranges.
    """
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(group, *order, "_read")
    dealt = dealt.sortWithinPartitions(group, *order, *(then or []), "_read")
    dealt = checkpointed(dealt.drop("_read").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", PLACE_BITS))
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    ranges = Window.partitionBy(group)
    before = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group,
        "_range",
        "_from",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(ranges).alias("n_rows"),
    )
    found = joined(dealt, counts, [group, "_range"])
    place = F.col("_at") - F.col("_from") + F.col("_before")
    return found.withColumn("place", place).drop("_at", "_range", "_from", "_before")

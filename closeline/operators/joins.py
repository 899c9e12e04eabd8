"""Join shapes that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more right rows than this is salted; it is about what one task sorts in memory.
HEAVY_ROWS = 1 << 20


def left_join_chain(left: DataFrame, *steps: tuple[DataFrame, str]) -> DataFrame:
    """`left` LEFT OUTER JOIN every (right, key) in turn, safe when a right has a hot key.

    Adaptive execution can split a skewed partition of an inner join on either side,
    but never the right side of a left outer join.  So the rows that meet are joined
    inner, all the way, and at every step those whose key the right side lacks, or that
    have none, are added by an anti join with its distinct keys, which combine map-side
    before they are shuffled.  Both joins of a step read the same shuffle of its left.
    """
    alone = []
    for right, key in steps:
        present = right.select(key).filter(F.col(key).isNotNull()).distinct()
        alone.append(left.join(present, key, "left_anti"))
        left = left.join(right, key)
    for rows in reversed(alone):
        left = left.unionByName(rows, allowMissingColumns=True)
    return left


def left_join_hot_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` LEFT OUTER JOIN `right` on `key`, safe when `right` has a hot key."""
    return left_join_chain(left, (right, key))


def left_join_salted(
    left: DataFrame, *steps: tuple[DataFrame, str, Column], heavy: int = HEAVY_ROWS
) -> DataFrame:
    """`left` LEFT OUTER JOIN every (right, key, spread) in turn, one join a step.

    The rows of each key on the right are counted, map-side first.  A key with more than
    `heavy` of them is dealt into a part per `heavy` rows by `spread`, a whole number of
    the right row that must come out the same whenever a task is run again; the left rows
    of such a key are repeated once per part.  Each right row is in one part, so each pair
    meets once, and as a counted key has partners, copies that met none are dropped.  Left
    rows of other keys, or without one, are neither repeated nor dropped.  The heavy keys
    are broadcast: there are at most a `heavy`-th as many as right rows.
    """
    for right, key, spread in steps:
        right = right.filter(F.col(key).isNotNull())
        counts = right.groupBy(key).agg(F.count("*").alias("_rows")).filter(f"_rows > {heavy}")
        parts = F.broadcast(counts.selectExpr(key, f"_rows div {heavy} + 1 AS _parts"))
        part = F.expr("coalesce(pmod(_spread, _parts), 0L) AS _part")
        shown = [c for c in right.columns if c != key]
        dealt = right.withColumn("_spread", spread.cast("long")).join(parts, key, "left")
        dealt = dealt.select(key, *shown, part, F.lit(True).alias("_met"))
        each = F.explode(F.expr("sequence(0L, coalesce(_parts, 1L) - 1)")).alias("_part")
        copies = left.join(parts, key, "left").select("*", each)
        left = copies.join(dealt, [key, "_part"], "left").filter("_parts IS NULL OR _met")
        left = left.drop("_part", "_parts", "_met")
    return left

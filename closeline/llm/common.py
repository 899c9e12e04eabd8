"""What several operators share: tables, words, checkpoints, null-safe joins."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, once A-Z are lower-cased.
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same gaps where A-Z count as letters.
ITEM_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words between white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
OTHER_SPACE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  `lower` does just that where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def item_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ITEM_GAP), "")


def n_item_words(text: Column) -> Column:
    """The number of `item_words`, which lower-casing does not change."""
    pieces = F.split(F.coalesce(text, F.lit("")), ITEM_GAP_ANY_CASE)
    return F.size(F.array_remove(pieces, "")).cast("long")


def one_space(text: Column) -> Column:
    """Every white-space character as a space; null as the empty text."""
    for c in OTHER_SPACE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.coalesce(text, F.lit(""))


def space_words(text: Column) -> Column:
    """Words between white space, as they are; null has none."""
    return F.array_remove(F.split(one_space(text), " "), "")


def in_row(words: Column, width: int) -> Column:
    """The runs of `width` neighbouring elements, as structs with fields "0", "1", ..."""
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) for i in range(width)]
    runs = F.arrays_zip(*shifted)
    return F.slice(runs, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))


def n_space_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once though `body` names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns, null equal to null."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on the named columns, null equal to null; `left` keeps its columns."""
    there = right.withColumnsRenamed({n: f"{n}__r" for n in on})
    match = reduce(lambda a, b: a & b, (left[n].eqNullSafe(there[f"{n}__r"]) for n in on))
    return left.join(there, match, how).drop(*(f"{n}__r" for n in on))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only a local session that sets none gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once: written to the shared folder as a compressed table and read again."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast if `df`, whose rows are of fixed width, has at most that many.

    Beyond it Spark joins by shuffle; results are the same.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def first_by(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The `most` rows of `df` with the least hashes of `columns`.

    Rows whose hash cannot be among them are dropped where they are, by a bound from a count
    that leaves twice as many and some, so that the task that orders them gets no more.
    """
    unit = (F.xxhash64(*columns) / F.lit(2.0**64)) + 0.5
    share = (2 * most + 1000) / max(1, df.count())
    return df.where(unit < share).orderBy(F.xxhash64(*columns), *columns).limit(most)

"""A corpus pipeline: five operators in a row, each on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read
again as the next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closeline.llm import decontaminate, mixing, near_dedup, pii, quality
from closeline.llm.common import joined, shared_folder, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ["doc_id", "text_hash"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The row number keeps the filter where it is: pushed down it would repeat the verdict's
    expressions inside each other.
    """
    judged = quality.judged(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    numbered = judged.withColumn("_row", F.monotonically_increasing_id())
    return numbered.where("kept AND _row >= 0").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null ids last), then text hash.

    Documents without words are in no group; those with equal ids and texts are one.
    """
    rows = joined(_hashed(docs), near_dedup.representatives(docs), KEY, "left_semi")
    return rows.dropDuplicates(KEY).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    marks = decontaminate.flagged_rows(docs, table(spark, sf_dir, "benchmark"))
    clean = marks.where("NOT contaminated").select(*KEY).distinct()
    return joined(_hashed(docs), clean, KEY, "left_semi").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal datum replaced by its kind."""
    found = pii.found(docs.select(*COLUMNS))
    text = F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted"))
    out = found.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: parts of blocks by shard and slot, with their words."""
    return mixing.mixed_text(docs.select(*COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The network and the hashes are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, with a table in the shared folder after each but the last."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

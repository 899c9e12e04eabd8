"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Time zone free results.
    "spark.sql.session.timeZone": "UTC",
    # Broadcast sides are chosen from measured sizes and hot partitions of inner
    # joins are split, both at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Prune fact rows by the keys of a filtered side before they are shuffled.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Python call sites of column expressions; costs more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings; the caller chooses master, memory and partitions."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder

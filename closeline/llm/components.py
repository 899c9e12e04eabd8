"""Connected components by minimum labels with shortcuts, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of `links` (a, b): the smallest node it is linked with.

    Each round every node takes the smallest label among its neighbours, then the label of
    its label, so that even a chain takes a number of rounds like the logarithm of its
    length.  Rounds are checkpointed.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "near").where("node <> near")
    both = checkpointed(both.distinct())
    labels = both.groupBy("node").agg(F.least("node", F.min("near")).alias("label"))
    labels = checkpointed(labels)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "near"), "near")
        least = seen.groupBy("node").agg(F.min("label").alias("seen"))
        stepped = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = stepped.join(of_label, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        stepped = checkpointed(stepped)
        labels = stepped.select("node", "label")
        if stepped.where("old <> label").isEmpty():
            return labels

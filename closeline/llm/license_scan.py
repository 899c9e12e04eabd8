"""License scans by diagonal voting.

Every rolling two-word gram of a document is joined with the places that gram has in the
license templates.  A match votes for the diagonal document position - template position:
a verbatim notice puts all its votes on one diagonal, an edited one on a few neighbouring
ones.  Votes are summed per document, template and diagonal; diagonals at most `GAP` apart
are merged; a merged run is verified by the share of the template's grams that it holds.

Base phrases are templates too.  A diagonal with all votes of a phrase is a place where its
words stand consecutively, as grams are compared by their words.

The templates are a list of the library, so the broadcast side is bounded.  Null and empty
texts have no words, no labels and score 0.  Documents are told apart by id and hash of the
text, so repeated rows agree; an empty table stays empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closeline.llm.common import in_row, item_words, joined, n_item_words

GRAM_WORDS = 2
#: Diagonals this close belong to one edited copy.
GAP = 3
#: Share of a template's grams that verifies a span.
COVERAGE = 0.75
MOST_TEMPLATE_WORDS = 1000

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Openings of public license notices and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "released into the public domain": "public-domain",
}


def template_grams(spark) -> DataFrame:
    """(template, label, is_base, need, at, first, second): the grams of all templates."""
    rows = []
    for is_base, templates in ((True, BASE), (False, NOTICES)):
        for number, (text, label) in enumerate(templates.items()):
            words = text.split()
            if not GRAM_WORDS <= len(words) <= MOST_TEMPLATE_WORDS:
                raise ValueError(f"a template of {len(words)} words: {text[:40]}")
            name = f"{'base' if is_base else 'notice'}-{number}"
            pairs = list(zip(words, words[1:]))
            rows += [(name, label, is_base, len(pairs), at, *pair) for at, pair in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "template string, label string, is_base boolean, need int, at int, first string, second string"
    )


def spans(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, is_base, start, diagonal_votes, coverage): merged runs."""
    pairs = F.posexplode(in_row(F.col("w"), GRAM_WORDS)).alias("pos", "g")
    grams = texts.select("doc_id", "text_hash", pairs)
    grams = grams.select("doc_id", "text_hash", "pos", F.col("g")["0"].alias("first"), F.col("g")["1"].alias("second"))
    templates = F.broadcast(template_grams(texts.sparkSession))
    key = ["doc_id", "text_hash", "template", "label", "is_base", "need"]
    votes = grams.join(templates, ["first", "second"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    votes = votes.select(*key, "diagonal", "at").distinct()
    summed = votes.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    runs = summed.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    full = F.size("ats") == F.col("need")
    merged = runs.groupBy(*key, "run").agg(
        F.sum(F.when(full, 1).otherwise(0)).alias("places"),
        F.min(F.when(full, F.col("diagonal"))).alias("first_place"),
        F.max(F.when(full, F.col("diagonal"))).alias("last_place"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"),
    )
    return merged.withColumn("coverage", F.col("held") / F.col("need")).drop("held", "need", "run")


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = hashed.select("doc_id", "text_hash", item_words(F.col("text")).alias("w"))
    is_place = F.col("is_base") & (F.col("places") > 0)
    found = (F.col("is_base") & (F.col("places") > 0)) | (~F.col("is_base") & (F.col("coverage") >= COVERAGE))

    def labels(where) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("label")))), ",")

    marks = spans(texts).groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(is_place, F.col("places"))).alias("n_base"),
        F.min(F.when(is_place, F.col("first_place"))).alias("first_word"),
        F.max(F.when(is_place, F.col("last_place"))).alias("last_word"),
        labels(is_place).alias("base_labels"),
        labels(found).alias("labels"),
        F.max("coverage").alias("score"),
    )
    sized = hashed.select("doc_id", "text_hash", n_item_words(F.col("text")).alias("n_words"))
    return joined(sized, marks, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

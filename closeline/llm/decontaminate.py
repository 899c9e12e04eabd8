"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A window is ten consecutive words of an item, or the whole of a shorter one.  Windows and
documents are taken as sets of positioned shingles.  For containment of the whole window its
prefix, in order of rarity, is one shingle: only places where a document holds the window's
rarest shingle are candidates.  The shingle's positions must leave room for the window on
both sides (length and positional bounds); then every shingle of the window must stand in
the document at its offset, compared by its words, which is exact containment.

Documents are read once for the shingles that any window has; those few rows are kept in the
checkpoint folder, and all later joins run on them.  Hashes of the benchmark's shingles, of
fixed width, are broadcast while there are at most `BROADCAST_ROWS`; beyond that Spark
shuffles.  Documents are told apart by id and hash of the text, so repeated rows agree.

A null text has no words and no hits; an item without words has no window; an item without
an id marks words but cannot be listed; `items_sha256` of no items is that of the empty
string.  Empty tables give empty or all-clean results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import broadcast_if_few, checkpointed, in_row, item_words, joined, n_item_words

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BROADCAST_ROWS = 2_000_000

DOCUMENT = ["doc_id", "text_hash"]


def windows(items: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, window, n): the distinct windows of every item; `window` joins n words."""
    worded = items.select("item_id", item_words(F.col("text")).alias("w")).where("size(w) > 0")
    sized = worded.withColumn("n", F.least(F.size("w"), F.lit(width)))
    starts = "sequence(1, size(w) - n + 1)"
    cut = sized.select(
        "item_id", "n", F.expr(f"explode(transform({starts}, s -> slice(w, s, n)))").alias("w")
    )
    return cut.select("item_id", F.concat_ws(" ", "w").alias("window"), "n").distinct()


def window_shingles(found: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(window, n, need, at, shingle): shingles of the distinct windows with their offsets."""
    cut = found.select("window", "n").distinct().withColumn("w", F.split("window", " "))
    cut = cut.withColumn("k", F.least("n", F.lit(width)))
    pieces = F.posexplode(
        F.expr("transform(sequence(1, n - k + 1), s -> concat_ws(' ', slice(w, s, k)))")
    )
    return cut.select("window", "n", (F.col("n") - F.col("k") + 1).alias("need"), pieces.alias("at", "shingle"))


def shared_shingles(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, shingle) of every document shingle in `wanted`."""
    hashes = wanted.select(F.xxhash64(F.split("shingle", " ")).alias("h")).distinct()
    hashes = broadcast_if_few(hashes, BROADCAST_ROWS)
    places = None
    for width in widths:
        cut = docs.select(*DOCUMENT, F.size("w").alias("n_words"), F.posexplode(in_row(F.col("w"), width)).alias("pos", "s"))
        cut = cut.withColumn("h", F.xxhash64("s")).join(hashes, "h", "left_semi")
        cut = cut.select(*DOCUMENT, "n_words", "pos", F.concat_ws(" ", *(F.col("s")[str(i)] for i in range(width))).alias("shingle"))
        places = cut if places is None else places.unionByName(cut)
    return places.join(wanted.select("shingle").distinct(), "shingle", "left_semi").distinct()


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, n, window): every place where a window stands in a document.

    `docs` has doc_id, text_hash and its words `w`.
    """
    shingles = window_shingles(found)
    widths = [r[0] for r in found.select(F.least("n", F.lit(SHINGLE_WORDS))).distinct().collect()]
    if not widths:
        widths = [SHINGLE_WORDS]
    places = checkpointed(shared_shingles(docs, shingles, sorted(widths)))
    rarity = places.groupBy("shingle").agg(F.count("*").alias("seen"))
    ranked = shingles.join(rarity, "shingle")
    prefix = ranked.groupBy("window", "n", "need").agg(
        F.min(F.struct("seen", "at", "shingle")).alias("rarest"), F.count("*").alias("present")
    )
    prefix = prefix.where("present = need").select("window", "n", "rarest.at", "rarest.shingle")
    candidates = (
        places.join(prefix, "shingle")
        .withColumn("start", F.col("pos") - F.col("at"))
        .where("start >= 0 AND start + n <= n_words")
        .select(*DOCUMENT, "start", "window")
    )
    needed = candidates.join(shingles, "window").withColumn("pos", F.col("start") + F.col("at"))
    met = joined(needed, places.select(*DOCUMENT, "pos", "shingle"), [*DOCUMENT, "pos", "shingle"], "left_semi")
    counted = met.groupBy(*DOCUMENT, "start", "n", "need", "window").count()
    return counted.where("`count` = need").select(*DOCUMENT, "start", "n", "window")


def flagged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return flagged_rows(docs, items).drop("text_hash")


def flagged_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As `flagged`, with text_hash."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = hashed.select(*DOCUMENT, item_words(F.col("text")).alias("w"))
    found = checkpointed(windows(items.select("item_id", "text")))
    places = checkpointed(occurrences(texts, found))
    hits = (
        places.select(*DOCUMENT, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
        .distinct()
        .groupBy(*DOCUMENT)
        .agg(F.count("*").alias("n_hit"))
    )
    listed = places.select(*DOCUMENT, "window").distinct().join(found.select("window", "item_id"), "window")
    listed = listed.groupBy(*DOCUMENT).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    marks = joined(hits, listed, DOCUMENT, "left")
    empty = F.array().cast("array<string>")
    sized = hashed.select(*DOCUMENT, n_item_words(F.col("text")).alias("n_words"))
    out = joined(sized, marks, DOCUMENT, "left").withColumn("items", F.array_sort(F.coalesce("items", empty)))
    return out.select(
        *DOCUMENT,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )

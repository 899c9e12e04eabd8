"""MinHash near-deduplication with an LSH forest.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal sets are one
class.  Each of `TREES` trees sorts the classes by its own `DEPTH` MinHash labels; classes
next to each other that share the longest prefixes, at least `LEAST_DEPTH` labels, are
candidates.  The depth adapts to the region: where few classes share the least prefix they
all are candidates of each other (at most `REACH` rows away), where many do, neighbours in
the order, which share more labels, are.

Candidates are confirmed on the full sets, remade from the texts, in three steps; each gives
components, and the next one looks only at classes that are not yet in one component, so
large groups of copies are not compared pair by pair.

1. The next neighbours of some trees.
2. All other candidates, and hubs: copies of one text may be far from each other and near that
   text alone, which no number of neighbours shows.  In every crowded region that holds several
   components the class with the most links so far is compared with all others of the region.
3. The classes of crowded regions that still lie in several components, by an exact
   set-similarity join: a pair similar enough shares one of the rarest shingles of each.

Candidates of the trees whose labels agree in less than `percent` - `MARGIN` percent, six standard
deviations under the similarity asked for, are not read; those of the exact join all are.

A null text, or one without words, has the empty set and is linked with nothing.  Repeated
rows are in one class.  A class's component is named by the smallest doc_id in it (null ids
last).  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, joined
from closeline.llm.components import components
from closeline.llm.neighbours import neighbour_pairs
from closeline.llm.word_hash import mixed, shingles

TREES, DEPTH, LEAST_DEPTH, REACH = 16, 6, 3, 8
#: Trees whose next neighbours are confirmed first.
FIRST_TREES = 4
#: Ratio of the sizes in one bucket of the exact join.
SIZE_STEP = 1.05
#: Shingles in front of a shared one that tell whether a pair has met before.
BEFORE = 4
#: Percent of labels by which a pair may fall short of the similarity before it is read.
MARGIN = 24
#: Shingles hashed together.
BLOCK = 4096

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def labels_of(hashes: np.ndarray) -> bytes:
    """Two-byte MinHash labels of a set, tree by tree."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[None, i : i + BLOCK] * FACTORS[:, None] + OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def set_class(hashes: np.ndarray) -> bytes:
    """A 128-bit fingerprint of a set."""
    sums = [mixed(hashes ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (1, 2)]
    return np.array(sums, dtype=np.uint64).tobytes()


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, labels); class and labels are null for empty sets."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                hashes = shingles(text, width)
                known = (set_class(hashes), labels_of(hashes)) if len(hashes) else (None, None)
                rows.append((doc_id, text_hash, len(hashes), *known))
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "n_shingles", "class", "labels"])
            yield out.astype({"doc_id": "Int64"})

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInPandas(describe, "doc_id long, text_hash long, n_shingles long, class binary, labels binary")


def _tree_pairs(chunk: pd.DataFrame) -> pd.DataFrame:
    """Candidates among rows (tree, labels, class) in their order; `next` marks neighbours."""
    trees = chunk["tree"].to_numpy()
    labels = np.frombuffer(b"".join(chunk["labels"]), dtype=">u2").reshape(len(chunk), DEPTH)
    classes = chunk["class"].to_numpy()
    least = labels[:, :LEAST_DEPTH]
    same = (trees[1:] == trees[:-1]) & (least[1:] == least[:-1]).all(axis=1)
    run = np.concatenate([[0], np.cumsum(~same)])
    crowded = np.bincount(run)[run] > REACH
    parts = []
    for step in range(1, REACH + 1):
        alike = run[step:] == run[:-step]
        if step > 2:
            alike &= ~crowded[step:]
        at = np.flatnonzero(alike)
        parts.append(
            pd.DataFrame(
                {"a": classes[at], "b": classes[at + step], "first": (trees[at] < FIRST_TREES) & (step == 1)}
            )
        )
    return pd.concat(parts, ignore_index=True)


def tree_rows(classes: DataFrame) -> DataFrame:
    """`classes` once for every tree, with `tree` and the tree's part of the labels."""
    size = 2 * DEPTH
    cut = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(TREES - 1)),
            lambda t: F.struct(t.alias("tree"), F.substring(F.col("labels"), t * size + 1, F.lit(size)).alias("labels")),
        )
    )
    kept = [c for c in classes.columns if c != "labels"]
    return classes.select(cut.alias("t"), *kept).select("t.tree", "t.labels", *kept)


def ordered_pairs(pairs: DataFrame, *others: str) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *others).where("a <> b")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, first): candidate pairs of classes, a < b, each once."""
    rows = tree_rows(classes.select("labels", "class"))
    pairs = neighbour_pairs(rows, ["tree", "labels", "class"], _tree_pairs, REACH, "a binary, b binary, first boolean")
    return ordered_pairs(pairs, "first").groupBy("a", "b").agg(F.max("first").alias("first"))


def with_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` with `label`, the component that the links give it; its own class without any."""
    labels = components(links).withColumnRenamed("node", "class")
    return classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def crowded(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, label, hub, hub_label) of the classes in crowded regions with several components.

    `classes` has class, labels and label.  A region is counted by hash before its rows are
    looked at; its hub, one row, is joined back to them.
    """
    degrees = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("degree"))
    known = classes.select("class", "labels", "label").join(degrees, "class", "left").na.fill(0, ["degree"])
    rows = tree_rows(known).withColumn("region", F.xxhash64("tree", F.substring("labels", 1, 2 * LEAST_DEPTH)))
    mark = F.xxhash64("label")
    sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    regions = checkpointed(sizes.where(f"n > {REACH} AND low <> high").select("region"))
    held = checkpointed(rows.join(regions, "region").select("region", "class", "label", "degree"))
    hubs = held.groupBy("region").agg(F.max(F.struct("degree", "class", "label")).alias("hub"))
    hubs = checkpointed(hubs.select("region", F.col("hub.class").alias("hub"), F.col("hub.label").alias("hub_label")))
    return held.join(hubs, "region").select("class", "label", "hub", "hub_label")


def exact_candidates(classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): all pairs of `classes` (class, label, n_shingles, text) in different components that may be similar enough.

    Sets of n and m shingles need to share (n + m) * percent / (100 + percent) of them, so in
    one order of all shingles, the rarest first, one of the first n - that + 1 is shared.
    Classes meet by such a shingle and the buckets of both sizes, whose least partner size
    bounds the number of shingles; the places of a shared shingle bound what may follow.
    Where they also share one of the `BEFORE` shingles in front of it, they have met by that.
    """

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for class_, text in zip(batch["class"], batch["text"]):
                hashes = shingles(text, width).view(np.int64)
                yield pd.DataFrame({"class": class_, "n": len(hashes), "shingle": hashes})

    spelled = checkpointed(classes.select("class", "text").mapInPandas(spell, "class binary, n long, shingle long"))
    often = spelled.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    # Shingles of one holder come first and match nothing; their number is the places before the others.
    shared = spelled.join(often, "shingle")
    by_class = Window.partitionBy("class")
    ordered = by_class.orderBy("holders", "shingle")
    place = F.row_number().over(ordered) + F.col("n") - F.count("*").over(by_class)
    # Where two classes share a shingle just before this one, they have met by it already.
    before = F.collect_list("shingle").over(ordered.rowsBetween(-BEFORE, -1))
    rows = shared.withColumns({"place": place, "before": before}).drop("holders")

    def bucket(size: str) -> str:
        return f"cast(floor(ln({size}) / ln({SIZE_STEP}D)) AS int)"

    least = f"(({percent} * n + 99) div 100)"
    rows = rows.withColumn("bucket", F.expr(bucket("n")))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence({bucket(least)}, {bucket(f'greatest(n, 100 * n div {percent})')})")))
    partner = f"greatest({least}, cast(floor(pow({SIZE_STEP}D, other)) AS bigint))"
    rows = rows.where(F.expr(f"place <= n + 1 - ({percent} * (n + {partner}) + {99 + percent}) div {100 + percent}"))
    rows = rows.withColumn("key", F.xxhash64("shingle", F.least("bucket", "other"), F.greatest("bucket", "other")))
    rows = rows.select("key", "class", "n", "place", "before", "bucket", "other").join(classes.select("class", "label"), "class")
    rows = checkpointed(rows)
    mark = F.xxhash64("label")
    mixed_keys = rows.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high")
    rows = checkpointed(rows.join(mixed_keys.select("key"), "key"))
    one, two = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "key")) for x in "ab")
    both = one.join(two, "key").where("class_a < class_b AND label_a <> label_b AND bucket_a = other_b AND bucket_b = other_a")
    both = both.where(f"{100 + percent} * (1 + least(n_a - place_a, n_b - place_b)) >= {percent} * (n_a + n_b)")
    both = both.where(~F.arrays_overlap("before_a", "before_b"))
    return both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and labels leave the similarity possible."""
    known = classes.select("class", "n_shingles", "labels")
    one, two = (known.toDF(n, f"n_{n}", f"labels_{n}") for n in "ab")
    least = max(0, percent - MARGIN) * TREES * DEPTH

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = [np.frombuffer(b"".join(batch[f"labels_{n}"]), dtype="u2").reshape(len(batch), TREES * DEPTH) for n in "ab"]
            yield batch.loc[100 * (signs[0] == signs[1]).sum(axis=1) >= least, ["a", "b"]]

    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = both.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    return both.select("a", "b", "labels_a", "labels_b").mapInPandas(agree, "a binary, b binary")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; `texts` has class and text."""
    one, two = (texts.select(F.col("class").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    pairs = checkpointed(pairs.select("a", "b"))

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for text_a, text_b in zip(batch["text_a"], batch["text_b"]):
                one, two = shingles(text_a, width), shingles(text_b, width)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                kept.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.loc[kept, ["a", "b"]]

    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(confirm, "a binary, b binary")


def linked_classes(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(class, label): the component of every class that is linked with another one."""
    holders = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("labels").alias("labels"), F.first("n_shingles").alias("n_shingles")
    )
    holders = checkpointed(holders)
    pairs = checkpointed(candidates(holders))
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    needed = holders.join(needed, "class").select("class", "n_shingles", "labels", "at.doc_id", "at.text_hash")
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = joined(plain, needed, ["doc_id", "text_hash"]).dropDuplicates(["class"])
    texts = checkpointed(texts.select("class", "n_shingles", "labels", "text"))
    classes = texts.select("class", "labels")
    links = checkpointed(confirmed(agreeing(pairs.where("first"), texts, percent), texts, width, percent))

    early = checkpointed(with_components(classes, links))
    spokes = crowded(early, links).where("label <> hub_label")
    spokes = ordered_pairs(spokes.select(F.col("class").alias("a"), F.col("hub").alias("b")))
    left, right = (early.select("class", "label").toDF(n, f"label_{n}") for n in "ab")
    apart = pairs.where("NOT first").select("a", "b").join(left, "a").join(right, "b")
    apart = apart.where("label_a <> label_b").select("a", "b").unionByName(spokes).distinct()
    links = checkpointed(links.unionByName(confirmed(agreeing(apart, texts, percent), texts, width, percent)))

    late = checkpointed(with_components(classes, links))
    dense = crowded(late, links).select("class", "label").distinct()
    dense = checkpointed(texts.join(dense, "class").select("class", "label", "n_shingles", "text"))
    exact = exact_candidates(dense, width, percent)
    links = checkpointed(links.unionByName(confirmed(exact, texts, width, percent)))
    return components(links).withColumnRenamed("node", "class")


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(class, doc_id, text_hash, n_shingles, label) of every document; label, its group, is null for empty sets."""
    rows = checkpointed(described(docs, width))
    labels = linked_classes(docs, rows, width, percent)
    named = rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    return checkpointed(named.drop("labels"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash) of one document of each group, the smallest (null ids last), and of all with empty sets."""
    named = grouped(docs, width, percent)
    first = named.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("at"))
    empty = named.where("label IS NULL").select("doc_id", "text_hash").distinct()
    return first.select("at.doc_id", "at.text_hash").unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, text_hash, n_shingles, component_id, kept."""
    named = grouped(docs, width, percent)
    smallest = named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    out = named.join(smallest, "label", "left")
    component = F.coalesce("smallest", "doc_id")
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )

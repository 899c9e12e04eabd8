"""SimHash near-deduplication by pigeonhole blocks.

A document's fingerprint has a bit set where more than half of the XXH64 hashes of its word
shingles have it; shingles count as often as they occur.  Documents with one fingerprint are one
class, and classes are linked whose fingerprints differ in at most `MOST_BITS` = 2 bits.

Fingerprints are split into four blocks of 16 bits.  Two differing bits lie in two blocks at
most, so a close pair has two blocks in common: classes meet by every choice of two blocks and
their values, and the Hamming distance of those that meet is verified.

A bucket, one choice and value, of more than `REACH` classes is crowded; its pairs are not made.
Its classes meet by single points instead: fingerprints that differ in two bits at most are
within one bit of a common point, and no more than 65 fingerprints are within one bit of any.
Each class is listed at its 65 points and linked with the smallest class of each, which is
verified as well.  This gives the components of all pairs with 65 rows a class.

A null text, or one without words, has the fingerprint zero and is linked like any other.
Repeated rows are in one class.  A component is named by its smallest doc_id, nulls left out; it is
null where all ids are.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed
from closeline.llm.components import components

MOST_BITS = 2
BITS, BLOCKS = 64, 4
BLOCK_BITS = BITS // BLOCKS
#: Classes of a bucket that are compared pair by pair.
REACH = 8
#: Shingles hashed together.
CHUNK = 1 << 16
SEED = 42

#: The bits of every byte, lowest first, and where the counts of each of a hash's bytes begin.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = np.arange(8) * 256


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of `width` lower-cased words with single spaces, or of all words where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(data[s:e], SEED) for s, e in spans), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number; zero without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        data = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        per_byte = np.bincount((data + _BYTE_OFFSETS).ravel(), minlength=8 * 256).reshape(8, 256)
        counts += (per_byte @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, print) of every document."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(text, width)) for text in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("print"))


def bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, print): every class in the bucket of each choice of two blocks and their values."""
    block = [f"(shiftright(print, {BLOCK_BITS * i}) & {(1 << BLOCK_BITS) - 1})" for i in range(BLOCKS)]
    # The choice stands above the two blocks it is made of.
    chosen = [
        f"shiftleft({i}L, {2 * BLOCK_BITS}) | shiftleft({block[one]}, {BLOCK_BITS}) | {block[two]}"
        for i, (one, two) in enumerate(combinations(range(BLOCKS), MOST_BITS))
    ]
    return classes.selectExpr(f"explode(array({', '.join(chosen)})) AS bucket", "print")


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, that differ in few enough bits."""
    return pairs.where(f"a < b AND bit_count(a ^ b) <= {MOST_BITS}").select("a", "b")


def pairs_of_buckets(held: DataFrame) -> DataFrame:
    """The close pairs of buckets (bucket, print) of at most `REACH` classes."""
    one, two = (held.select("bucket", F.col("print").alias(n)) for n in "ab")
    return verified(one.join(two, "bucket"))


def links_of_points(classes: DataFrame) -> DataFrame:
    """Links with the components of all close pairs of `classes` (print), by the points within one bit of each."""
    flips = ", ".join(f"print ^ shiftleft(1L, {i})" for i in range(BITS))
    listed = classes.selectExpr(f"explode(array(print, {flips})) AS point", "print")
    # At most 65 fingerprints are within one bit of a point.
    at = listed.groupBy("point").agg(F.collect_set("print").alias("near")).where("size(near) > 1")
    return verified(at.select(F.array_min("near").alias("a"), F.explode("near").alias("b")))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links of the classes (print) that give the components of all close pairs."""
    rows = bucketed(classes)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = checkpointed(rows.join(sizes, "bucket"))
    crowded = held.where(f"n > {REACH}").select("print").distinct()
    return pairs_of_buckets(held.where(f"n <= {REACH}")).unionByName(links_of_points(crowded)).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(fingerprints(docs, width))
    classes = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    labels = checkpointed(components(checkpointed(links(classes.select("print")))).withColumnRenamed("node", "print"))
    # The joins below end in a table or the result, so that adaptive execution can split a print
    # or a label that many rows have; the other side has one row of it.
    named = checkpointed(classes.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = checkpointed(named.select("print", "label").join(smallest, "label").select("print", "component_id"))
    return rows.join(of_class, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )

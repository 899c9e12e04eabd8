"""Toxicity by compression distance.

Two zstandard dictionaries are trained from byte statistics of the labelled texts.  Both begin
with the same windows of ordinary texts, so that common language compresses alike; each ends
with its class's telling stretches: runs of bytes whose 6-byte grams stand in far more of its
texts than the other class's lead to expect, those of the most texts last, where matches are
cheapest.  Matches are at least a gram long.  Near copies, told by their least hashes, count
as one text.  Every overlapping window of a text is compressed with both dictionaries; its
distance is how many bytes shorter the toxic one makes it.  Distances of the training texts
calibrate the thresholds: a logistic curve over the largest, the mean of the three largest
and the mean distance, and the share of windows over the ordinary texts' 99th percentile.

Labels are learned only from rows whose crc32 of the id modulo 5 is not 0, from at most
`TRAIN_DOCUMENTS` different texts a class, the first by hash, each read whole.  Scores use the
text alone, the whole of it.  Classes weigh the same in the calibration.

Null and empty texts have one window, the empty one, and get its score.  Ids with several
labels count as toxic if any label says so.  Repeated rows repeat; an empty table stays empty;
without two texts of each class, or a stretch that tells toxic texts, every score is 0.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, first_by

WINDOW, STEP = 32, 16
#: Length of the grams that statistics are about, and of the shortest match.
GRAM = 6
#: How far above the expected number of texts a telling gram stands, in deviations a root of all texts.
TELLING, PRIOR = 0.65, 0.1
#: Windows of ordinary texts in both dictionaries, their bytes, and the bytes of telling stretches.
BASE_WINDOWS, BASE_BYTES, TAIL_BYTES = 64, 64, 1024
#: Most telling grams and stretches of a class that are looked at, and a stretch's longest.
MOST_GRAMS, MOST_STRETCHES, LONGEST = 4096, 512, 64
FOLDS = 5
TRAIN_DOCUMENTS = 1500
FIT_STEPS = 2000
#: Odd factors of the hashes whose least tells near copies.
COPY_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
COPY_BYTES = 8

#: Distances of a text: ascending values, and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Model:
    """Dictionaries, feature scales and the logistic curve; empty without training texts."""

    toxic: bytes = b""
    ordinary: bytes = b""
    high: float = 0.0
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def windows(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def packed(data: bytes, width: int) -> np.ndarray:
    """Every run of `width` bytes, at most 8, as a number."""
    at = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    runs = np.zeros(max(0, len(at) - width + 1), dtype=np.uint64)
    for i in range(width if len(runs) else 0):
        runs = (runs << np.uint64(8)) | at[i : i + len(runs)]
    return runs


def least_hashes(data: bytes) -> list[int]:
    """Least hashes of the text's runs, most often alike in near copies."""
    runs = packed(data.ljust(COPY_BYTES), COPY_BYTES)
    return [int((runs * np.uint64(f)).min().view(np.int64)) for f in COPY_FACTORS]


def stretches(data: bytes, telling: np.ndarray) -> set[bytes]:
    """The text's longest runs covered by overlapping or adjoining telling grams."""
    at = np.flatnonzero(np.isin(packed(data, GRAM), telling))
    if not len(at):
        return set()
    cut = np.flatnonzero(np.diff(at) > GRAM) + 1
    firsts, lasts = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
    return {data[i : j + GRAM] for i, j in zip(firsts, lasts) if j + GRAM - i <= LONGEST}


class Distance:
    """Compresses windows with both dictionaries of a model."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        parameters = zstandard.ZstdCompressionParameters(
            window_log=14,
            hash_log=14,
            chain_log=13,
            search_log=3,
            min_match=GRAM,
            strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False,
            write_dict_id=False,
        )
        self.pair = []
        for raw in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.pair.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))

    def of(self, found: list[bytes]) -> np.ndarray:
        ordinary, toxic = (c.compress for c in self.pair)
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in found], dtype=float)


def features(distances: np.ndarray, high: float) -> list[float]:
    top = np.sort(distances)[::-1]
    return [top[0], top[:3].mean(), distances.mean(), (distances > high).mean()]


def counted_features(values: np.ndarray, counts: np.ndarray, high: float) -> list[float]:
    """`features` of distances given as ascending values and how often each occurs."""
    top = np.repeat(values[::-1], np.minimum(counts[::-1], 3))[:3]
    return [top[0], top.mean(), values @ counts / counts.sum(), counts[values > high].sum() / counts.sum()]


def counted_percentile(values: np.ndarray, counts: np.ndarray, percent: float) -> float:
    """numpy's percentile of distances given as ascending values and how often each occurs."""
    ends = np.cumsum(counts)
    at = percent / 100 * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, k, side="right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def _tails(different: DataFrame) -> dict[int, bytes]:
    """The telling stretches of each class (1 toxic, 0 ordinary) of texts (toxic, text), end to end."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                grams = np.unique(packed((text or "").encode(), GRAM)).view(np.int64)
                yield pd.DataFrame({"gram": grams, "toxic": toxic})

    sizes = {r.toxic: r["count"] for r in different.groupBy("toxic").count().collect()}
    sides = F.explode(
        F.array(*(F.struct(F.lit(c).alias("side"), F.col(f"n{c}").alias("mine"), F.col(f"n{1 - c}").alias("theirs")) for c in (1, 0)))
    )
    counted = different.mapInPandas(spell, "gram long, toxic int").groupBy("gram")
    counted = counted.agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    sided = counted.select("gram", sides.alias("s")).select("gram", "s.*")
    texts = F.when(F.col("side") == 1, sizes[1]).otherwise(sizes[0])
    others = F.when(F.col("side") == 1, sizes[0]).otherwise(sizes[1])
    expected = texts * (F.col("theirs") + PRIOR) / others
    excess = (F.col("mine") - expected) / F.sqrt(texts * (expected + 1))
    sided = checkpointed(sided.select("gram", "side", excess.alias("excess")).where(f"excess >= {TELLING}"))
    telling = {
        c: np.sort(np.array([r.gram for r in sided.where(F.col("side") == c).orderBy(F.desc("excess"), "gram").limit(MOST_GRAMS).collect()], dtype=np.uint64))
        for c in (1, 0)
    }
    shared = different.sparkSession.sparkContext.broadcast(telling)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                yield pd.DataFrame({"stretch": list(stretches((text or "").encode(), shared.value[toxic])), "toxic": toxic})

    held = different.mapInPandas(cut, "stretch binary, toxic int").groupBy("toxic", "stretch").agg(F.count("*").alias("texts"))
    held = checkpointed(held)
    tails = {}
    for c in (1, 0):
        often = held.where((F.col("toxic") == c) & (F.col("texts") >= 0.5 * sizes[c] ** 0.25))
        found = often.orderBy(F.desc("texts"), F.desc(F.length("stretch")), "stretch").limit(MOST_STRETCHES).collect()
        kept: list[bytes] = []
        for stretch in (bytes(r.stretch) for r in found):
            if any(stretch in k for k in kept):
                continue
            if sum(map(len, kept)) + len(kept) + len(stretch) > TAIL_BYTES:
                break
            kept.append(stretch)
        tails[c] = b" ".join(reversed(kept))
    return tails


def trained(texts: DataFrame) -> tuple[bytes, bytes]:
    """Dictionaries of toxic and ordinary texts (doc_id, text_hash, toxic, text); empty if nothing tells toxic ones."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = [least_hashes((t or "").encode()) for t in batch["text"]]
            one, two = zip(*least) if least else ((), ())
            yield batch[["doc_id", "text_hash", "toxic"]].assign(one=list(one), two=list(two))

    copies = texts.mapInPandas(sketch, "doc_id long, text_hash long, toxic int, one long, two long")
    first = copies.groupBy("toxic", "one").agg(F.min(F.struct("doc_id", "text_hash", "two")).alias("at"))
    first = first.groupBy("toxic", "at.two").agg(F.min("at").alias("at")).select("at.doc_id", "at.text_hash")
    different = checkpointed(texts.join(first, ["doc_id", "text_hash"]))
    tails = _tails(different)
    if not tails[1]:
        return b"", b""
    base = bytearray()
    for row in different.where("toxic = 0").orderBy("text_hash", "doc_id").limit(BASE_WINDOWS).select("text_hash", "text").collect():
        data = (row.text or "").encode()
        at = row.text_hash % max(1, len(data) // BASE_BYTES) * BASE_BYTES
        base += data[at : at + BASE_BYTES]
    common = bytes(base) + b" "
    return common + tails[1], common + tails[0]


def calibrated(raw: tuple[bytes, bytes], toxic: list[Counts], ordinary: list[Counts]) -> Model:
    """A model of the dictionaries and the distances of every text, as ascending values and counts."""
    every: Counter = Counter()
    for values, counts in ordinary:
        every.update(dict(zip(values.tolist(), counts.tolist())))
    values = np.array(sorted(every))
    high = counted_percentile(values, np.array([every[v] for v in values.tolist()]), 99)
    rows = np.array([counted_features(*text, high) for texts in (toxic, ordinary) for text in texts])
    label = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    share = np.where(label == 1, 0.5 / len(toxic), 0.5 / len(ordinary))
    centre, scale = rows.mean(0), rows.std(0) + 1e-9
    x = np.column_stack([(rows - centre) / scale, np.ones(len(rows))])
    weights = np.zeros(x.shape[1])
    for _ in range(FIT_STEPS):
        error = (1 / (1 + np.exp(-x @ weights)) - label) * share
        weights -= 1.0 * (x.T @ error + 1e-4 * weights)
    return Model(*raw, high, tuple(centre), tuple(scale), tuple(weights))


def score(distances: np.ndarray, model: Model) -> float:
    row = np.array(features(distances, model.high))
    x = np.append((row - model.centre) / model.scale, 1.0)
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded training sample; its grams, stretches and counts of its distances pass by the driver."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    known = checkpointed(plain.drop("text").join(marks, "doc_id").distinct())
    # Rows are chosen by hash before their texts are fetched.
    parts = [first_by(known.where(F.col("toxic") == c), ["doc_id", "text_hash"], TRAIN_DOCUMENTS) for c in (1, 0)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = checkpointed(plain.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]))
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if min(sizes.get(c, 0) for c in (1, 0)) < 2:
        return Model()
    pair = trained(texts)
    if not pair[0]:
        return Model()
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(*shared.value)
        for batch in batches:
            found = [np.unique(distance.of(windows(text)), return_counts=True) for text in batch["text"]]
            values, counts = zip(*found) if found else ((), ())
            yield batch[["doc_id", "text_hash", "toxic"]].assign(values=list(values), counts=list(counts))

    rows = texts.mapInPandas(count, "doc_id long, text_hash long, toxic int, values array<double>, counts array<long>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text_hash))
    toxic, ordinary = ([(np.array(r["values"]), np.array(r["counts"])) for r in rows if r.toxic == label] for label in (1, 0))
    return calibrated(pair, toxic, ordinary)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`."""
    model = fitted(docs, labels)
    parts = (model.toxic, model.ordinary, model.high, model.centre, model.scale, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Model(*shared.value)
        distance = Distance(known.toxic, known.ordinary) if known.toxic else None
        for batch in batches:
            yield batch.map(lambda t: score(distance.of(windows(t)), known) if distance else 0.0).astype(float)

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Repeated passages by sparse suffix arrays.

Of every text's suffixes only those are retained that begin at a minimiser: the word run with
the least hash among `SPACING` neighbouring ones, which the content alone selects, so equal
passages retain equal suffixes.  Every window of `least_words` words has such a suffix in its
first `SPACING` words, and the `prefix` words from there still lie in the window.  Retained
suffixes of all texts are sorted by the hash of that prefix; those that another document
holds too select the windows around them, and these are sorted by that hash and the hash of
the whole window.  Neighbours with equal windows are pairs of documents, whose texts are compared along
every diagonal (the difference of the two places) that brings a shared window together:
runs of `least_words` equal words or more are returned.

Each holder of a window is paired with the next ones in the order of ids, not with all, so a
passage that m documents share gives about m pairs, which link all of them.  Every window
that stands in two documents lies in a returned passage of each of its holders, at every
place.  A passage's ends are those of the pair: where each of its windows stands in more
documents, the runs returned may cover it in overlapping parts.  Sorting deals rows out by
ranges of window and document, so a passage that a third of all documents share is spread
over many tasks.

Texts shorter than `least_words`, empty or null have no such passage.  Rows with equal
doc_id and text are one document; repeats within one document are not reported.  Words are
told apart by 64-bit hashes.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, joined
from closeline.llm.neighbours import neighbour_pairs
from closeline.llm.word_hash import runs, words

LEAST_WORDS = 50
#: Words of the runs whose hashes select suffixes, and runs among which one is selected.
RUN, SPACING = 8, 24
#: Texts whose suffixes make one batch.
TEXTS = 1000


def selected(hashes: np.ndarray) -> np.ndarray:
    """The place of the leftmost least hash of every `SPACING` neighbours."""
    if len(hashes) < SPACING:
        return np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, SPACING)
    block = 1 << 16
    parts = [views[i : i + block].argmin(axis=1) + np.arange(i, min(i + block, len(views))) for i in range(0, len(views), block)]
    return np.concatenate(parts)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Each selected place once."""
    return np.unique(selected(hashes))


def suffixes(docs: DataFrame, least_words: int) -> DataFrame:
    """(prefix, doc_id, text_hash) of the retained suffixes, each once."""
    prefix = _prefix_words(least_words)

    def of_text(text: str | None) -> np.ndarray:
        hashes = words(text)
        whole = runs(hashes, prefix)
        return np.unique(whole[minimisers(runs(hashes, RUN)[: len(whole)])]).view(np.int64)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["doc_id", "text_hash"])
    return hashed.mapInPandas(_by_text(of_text, ["prefix"], "text"), "prefix long, doc_id long, text_hash long")


def shared_windows(texts: DataFrame, least_words: int) -> DataFrame:
    """(prefix, window, doc_id, text_hash), each once, of the windows around the suffixes `prefixes` of each text.

    A window of `least_words` words has one retained suffix that begins in its first
    `SPACING` words: the minimiser of those.  `prefix` is that one's.
    """
    prefix = _prefix_words(least_words)

    def of_text(text: str | None, prefixes: np.ndarray) -> np.ndarray:
        hashes = words(text)
        whole = runs(hashes, prefix).view(np.int64)
        at = whole[selected(runs(hashes, RUN)[: len(whole)])]
        held = np.isin(at, prefixes)
        windows, first = np.unique(runs(hashes, least_words)[held], return_index=True)
        return np.stack([at[held][first], windows.view(np.int64)], axis=1)

    schema = "prefix long, window long, doc_id long, text_hash long"
    return texts.mapInPandas(_by_text(of_text, ["prefix", "window"], "text", "prefixes"), schema)


def _prefix_words(least_words: int) -> int:
    prefix = least_words - SPACING + 1
    if prefix < RUN:
        raise ValueError(f"passages need {SPACING + RUN - 1} words or more")
    return prefix


def _by_text(of_text: Callable[..., np.ndarray], names: list[str], *columns: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (`names`, doc_id, text_hash) of what `of_text` finds in the texts of a batch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for i in range(0, len(whole_batch), TEXTS):
                batch = whole_batch.iloc[i : i + TEXTS]
                found = [of_text(*values) for values in zip(*(batch[c] for c in columns))]
                counts = [len(f) for f in found]
                out = pd.DataFrame(np.concatenate(found).reshape(-1, len(names)), columns=names)
                out["doc_id"] = batch["doc_id"].astype("Int64").repeat(counts).array
                out["text_hash"] = batch["text_hash"].repeat(counts).array
                yield out

    return rows


HOLDER = "shared long, doc long, hash long"
PAIR = "doc_a long, hash_a long, doc_b long, hash_b long"


def _holders(chunk: pd.DataFrame) -> pd.DataFrame:
    """The sorted rows whose prefix stands in another document as well; documents have it once."""
    prefix = chunk["prefix"].to_numpy()
    same = np.concatenate([[False], prefix[1:] == prefix[:-1], [False]])
    held = chunk[same[1:] | same[:-1]]
    return held.set_axis(["shared", "doc", "hash"], axis=1)


def _matches(chunk: pd.DataFrame) -> pd.DataFrame:
    """For each row the one before it with the same window, in sorted rows; documents have it once.

    The windows around one suffix stand together and return a pair once, so the number of
    pairs does not grow with the number of chunks that the rows are cut into.
    """
    prefix, window = chunk["prefix"].to_numpy(), chunk["window"].to_numpy()
    at = np.flatnonzero((window[1:] == window[:-1]) & (prefix[1:] == prefix[:-1]))
    doc, text_hash = chunk["doc_id"].astype("Int64"), chunk["text_hash"].to_numpy()
    pairs = {"doc_a": doc.iloc[at].array, "hash_a": text_hash[at], "doc_b": doc.iloc[at + 1].array, "hash_b": text_hash[at + 1]}
    return pd.DataFrame({"prefix": prefix[at], **pairs}).drop_duplicates().drop(columns="prefix")


def equal_runs(one: np.ndarray, two: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """(start in `two`, words) of the equal runs where `two[i]` meets `one[i + shift]`."""
    low, high = max(0, -shift), min(len(two), len(one) - shift)
    if high - low < least:
        return []
    equal = np.concatenate([[False], one[low + shift : high + shift] == two[low:high], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    return [(int(s) + low, int(e - s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= least]


def diagonals(one: np.ndarray, two: np.ndarray, least: int) -> list[int]:
    """Shifts that bring every window of `two` that stands in `one` to a place of it, and the other way round."""
    windows = [runs(hashes, least) for hashes in (one, two)]
    (known_one, first_one), (known_two, first_two) = (np.unique(w, return_index=True) for w in windows)
    _, in_one, in_two = np.intersect1d(known_one, known_two, assume_unique=True, return_indices=True)
    shifts = []
    for sign, whole, known, first in ((1, windows[1], known_two[in_two], first_one[in_one]), (-1, windows[0], known_one[in_one], first_two[in_two])):
        at = np.flatnonzero(np.isin(whole, known))
        shifts.append(sign * (first[np.searchsorted(known, whole[at])] - at))
    return np.unique(np.concatenate(shifts)).tolist()


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, other_doc_id, other_start, n_words): passages of `doc_id` that stand in another document.

    Places count words between white space from 0.
    """
    order = ["prefix", "doc_id", "text_hash"]
    rows = checkpointed(suffixes(docs, least_words).select(*order))
    held = neighbour_pairs(rows, order, _holders, 2, HOLDER)
    held = checkpointed(held.groupBy("doc", "hash").agg(F.collect_set("shared").alias("prefixes")))
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    needed = held.toDF("doc_id", "text_hash", "prefixes")
    texts = joined(plain, needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    texts = checkpointed(texts)
    order = ["prefix", "window", "doc_id", "text_hash"]
    rows = checkpointed(shared_windows(texts, least_words).select(*order))
    pairs = neighbour_pairs(rows, order, _matches, 2, PAIR)
    one, two = ("doc_a", "hash_a"), ("doc_b", "hash_b")
    lines = checkpointed(pairs.select(*one, *two).distinct())
    texts = texts.select("doc_id", "text_hash", "text")
    with_one = joined(lines, texts.toDF(*one, "text_a"), list(one))
    both = joined(with_one, texts.toDF(*two, "text_b"), list(two))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "other_doc_id", "other_start", "n_words"]
        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*(batch[c] for c in ("doc_a", "doc_b", "text_a", "text_b"))):
                one, two = words(text_a), words(text_b)
                for shift in diagonals(one, two, least_words):
                    found += [(b, s, a, s + shift, n) for s, n in equal_runs(one, two, shift, least_words)]
            yield pd.DataFrame(found, columns=columns).astype({"doc_id": "Int64", "other_doc_id": "Int64"})

    schema = "doc_id long, start long, other_doc_id long, other_start long, n_words long"
    return both.select("doc_a", "doc_b", "text_a", "text_b").mapInPandas(extend, schema)

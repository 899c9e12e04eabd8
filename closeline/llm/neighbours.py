"""Pairs of neighbours in a sorted order that is cut into many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed

#: Rows looked at together; the last `carry` of them are looked at again with the next.
CHUNK = 100_000


def neighbour_pairs(
    rows: DataFrame,
    order: list[str],
    pairs_of: Callable[[pd.DataFrame], pd.DataFrame],
    carry: int,
    schema: str,
) -> DataFrame:
    """What `pairs_of` finds in runs of rows sorted by `order`.

    Rows are dealt out by ranges of the whole order, so rows that share a long prefix spread
    over as many tasks as they need.  A task also hands on its first and last `carry` rows;
    those few rows, a constant number for each task, are sorted once more, so that
    neighbours on two sides of a cut are seen.  `schema` is that of the pairs.
    """
    names = rows.columns
    types = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    pair_names = [c.split()[0] for c in schema.split(", ")]

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, waiting = None, None, []

        def flush() -> pd.DataFrame:
            nonlocal last
            chunk = pd.concat(([] if last is None else [last]) + waiting, ignore_index=True)
            last = chunk.tail(carry)
            waiting.clear()
            return pairs_of(chunk)

        for batch in batches:
            first = batch.head(carry) if first is None else first
            waiting.append(batch)
            if sum(map(len, waiting)) >= CHUNK:
                yield flush().reindex(columns=pair_names + names)
        if waiting:
            yield flush().reindex(columns=pair_names + names)
        if first is not None:
            yield pd.concat([first, last]).drop_duplicates().reindex(columns=pair_names + names)

    keys = [F.col(n) for n in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out = checkpointed(dealt.mapInPandas(found, f"{schema}, {types}"))
    is_edge = F.col(order[0]).isNotNull()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = list(batches)
        if edges:
            yield pairs_of(pd.concat(edges, ignore_index=True))[pair_names]

    edges = out.where(is_edge).select(*names).coalesce(1).sortWithinPartitions(*keys)
    return out.where(~is_edge).select(*pair_names).unionByName(edges.mapInPandas(across, schema))

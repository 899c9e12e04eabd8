"""Send the ids of a gate's applications down to the tables hanging off them.

A rule that covers few applications needs few rows of their loans, follow-ups,
valuations and records, yet each child table is shuffled whole before it meets them.
Where the applications are counted to be few, their ids are broadcast to the child
tables, and the ids of the children that are left to the tables below, so that rows
nobody looks at leave at the scan.  A table whose ids are too many is left as it is,
and so are those below it: the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]

# Tables by the key they are thinned by, and the table whose ids thin them.
BY_APPLICATION = ("loans", "legal_closing_informations", "term_sheets", "borrowers")
BELOW = (
    ("loans", "loan_id", ("loan_follow_ups", "properties")),
    ("properties", "property_id", ("property_valuations",)),
)


class Thinned(Mapping[str, DataFrame]):
    """`tables`, some of them replaced."""

    def __init__(self, tables: Tables, instead: Mapping[str, DataFrame]) -> None:
        self._tables, self._instead = tables, instead

    def __getitem__(self, name: str) -> DataFrame:
        return self._instead[name] if name in self._instead else self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


def few(ids: DataFrame, most: int) -> DataFrame | None:
    """The ids, to be broadcast, if at most `most` rows hold them.

    Counting stops beyond that, and one column of so many rows is all that is ever sent.
    """
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else None


def reduced(tables: Tables, applications: DataFrame, most: int, *needed: str) -> Tables:
    """The `needed` tables without rows that hang off no one of `applications` (application_id).

    Ids are sent down as long as `most` rows hold them; each step counts them first.
    """
    ids = few(applications.select("application_id"), most)
    if ids is None:
        return tables
    above = {upper for upper, _, lower in BELOW if any(n in needed for n in lower)}
    if "property_valuations" in needed:
        above.add("loans")
    wanted = {*needed, *above}
    instead = {
        name: tables[name].join(ids, "application_id", "left_semi")
        for name in BY_APPLICATION
        if name in wanted
    }
    for upper, key, lower in BELOW:
        if upper not in instead or not any(name in wanted for name in lower):
            continue
        ids = few(instead[upper].selectExpr(f"id AS {key}"), most)
        if ids is not None:
            for name in lower:
                instead[name] = tables[name].join(ids, key, "left_semi")
    return Thinned(tables, instead)

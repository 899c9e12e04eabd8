"""SQL text of label rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def quoted(values: Iterable[str]) -> str:
    """The values as a list of SQL string literals."""
    return ", ".join(f"'{value}'" for value in values)


def either(*conditions: str) -> str:
    return "(" + " OR ".join(f"({c})" for c in conditions) + ")"


def both(*conditions: str) -> str:
    return "(" + " AND ".join(f"({c})" for c in conditions) + ")"


def first_match(rungs: Sequence[tuple[str, str]], otherwise: str | None = None) -> str:
    """Label of the first rung whose condition is true.

    A NULL condition does not match.  Without `otherwise` the label is NULL when
    no rung matches.
    """
    arms = " ".join(f"WHEN {condition} THEN '{label}'" for label, condition in rungs)
    default = "" if otherwise is None else f" ELSE '{otherwise}'"
    return f"CASE {arms}{default} END"

"""SQL text of name and label helpers."""

from __future__ import annotations


def full_name(first: str, last: str) -> str:
    """'first last'; NULL when either part is NULL."""
    return f"concat({first}, ' ', {last})"


def sentence_case(value: str) -> str:
    """First letter of the whole text upper case, the rest lower case.

    Not `initcap`, which would raise the first letter of every word.
    """
    return f"concat(upper(left({value}, 1)), lower(substr({value}, 2)))"

"""Date arithmetic with the semantics the queries need, as SQL text."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass


def hour_index(ts: str) -> str:
    """SQL: number of clock hours since the epoch, by the wall clock of `ts`."""
    return f"(datediff(to_date({ts}), DATE '1970-01-01') * 24 + hour({ts}))"


def hour_boundaries(start: str, end: str) -> str:
    """SQL: hour boundaries crossed between two timestamps.

    00:59 -> 02:01 crosses two.  Spark's own hour difference counts elapsed
    hours and would say one.
    """
    return f"({hour_index(end)} - {hour_index(start)})"


def whole_days(days: str) -> str:
    """SQL: a possibly fractional day count as an integer, halves away from zero."""
    return f"CAST(round({days}) AS INT)"


@dataclass(frozen=True)
class MonthOf:
    """The calendar month of a date, as plain dates that become literals."""

    as_of: dt.date

    @property
    def start(self) -> dt.date:
        return self.as_of.replace(day=1)

    @property
    def end(self) -> dt.date:
        last = calendar.monthrange(self.as_of.year, self.as_of.month)[1]
        return self.as_of.replace(day=last)

    @property
    def next_start(self) -> dt.date:
        return self.end + dt.timedelta(days=1)

    @property
    def days_left(self) -> int:
        return (self.end - self.as_of).days

    def contains(self, day: str) -> str:
        """SQL: `day` falls in the month, whatever its time of day."""
        return f"({day} >= DATE '{self.start}' AND {day} < DATE '{self.next_start}')"

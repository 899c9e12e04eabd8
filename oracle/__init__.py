"""Independent SQL for every registered query, run by DuckDB on the same files.

The Spark plans compare dates with offsets taken from the business calendar.  The
SQL never looks at an offset: it counts business days between two dates.
"""

from oracle.queries import oracle_queries

__all__ = ["oracle_queries"]

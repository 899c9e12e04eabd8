"""Readers for lending tables and sinks for results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from closeline.sources.schemas import SCHEMAS, columns_of

# Types that stand for each other: no result depends on which of them a column has.
ALIKE = {
    **dict.fromkeys(("tinyint", "smallint", "int", "long"), "bigint"),
    "timestamp_ntz": "timestamp",
}


def _kind(name: str) -> str:
    """A type without its width; decimals of any precision are alike."""
    return "decimal" if name.startswith("decimal") else ALIKE.get(name, name)


def mistyped(name: str, table: DataFrame) -> list[str]:
    """Columns of a table whose type would change results, as `column found, not wanted`."""
    found = dict(table.dtypes)
    wanted = (field.split() for field in SCHEMAS[name].split(", ") if field)
    return [
        f"{column} {found[column]}, not {kind}"
        for column, kind in wanted
        if _kind(found[column]) != _kind(kind)
    ]


class LendingTables(Mapping[str, DataFrame]):
    """Lending tables by name, opened on first use, their columns and types checked."""

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self._open = open_table
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._opened:
            table = self._open(name)
            missing = set(columns_of(name)) - set(table.columns)
            if missing:
                raise ValueError(f"table {name} lacks columns {sorted(missing)}")
            if wrong := mistyped(name, table):
                raise ValueError(f"table {name} has columns of other types: {'; '.join(wrong)}")
            self._opened[name] = table
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)


def from_files(spark: SparkSession, root: str, file_format: str = "parquet") -> LendingTables:
    """Tables stored as `root/<name>` in any Spark file format."""
    return LendingTables(lambda name: spark.read.format(file_format).load(f"{root}/{name}"))


def from_catalog(spark: SparkSession, names: Mapping[str, str]) -> LendingTables:
    """Tables of the session catalog; `names` maps each to its qualified name."""
    return LendingTables(lambda name: spark.table(names[name]))


def from_frames(frames: Mapping[str, DataFrame]) -> LendingTables:
    return LendingTables(lambda name: frames[name])


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a session view and return it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_catalog_view(
    spark: SparkSession, name: str, columns: Sequence[str], query: str
) -> DataFrame:
    """Create or replace a view in the catalog and return it.

    `query` is SQL over catalog tables, as a view that outlives its session cannot name
    what the session alone knows.  Its columns are renamed to `columns` by position.
    """
    listed = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} ({listed}) AS {query}")
    return spark.table(name)


def publish_table(df: DataFrame, name: str, file_format: str = "parquet") -> DataFrame:
    """Write a result as a catalog table and return it."""
    df.write.format(file_format).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)

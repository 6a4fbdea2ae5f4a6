"""Reading the case-file tables and the access tables, from Parquet or over JDBC.

Times are the wall clock of the administration. A source that stores them without a zone is
read as it stands, whatever zone the JVM is in; one that stores instants needs the zone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from casestats.sources.schemas import ACCESS_TABLES, CASE_TABLES, SPLIT_KEYS, schema_of
from casestats.sources.staging import Staging, stage

# Rows of a JDBC table that one task reads.
ROWS_PER_SPLIT = 1_000_000


class CaseTables(dict):
    """Source tables by name.

    Frames that several marts share (named units, process headers, ...) are derived
    once per instance and kept under a name. Those that are written go to `staging`, if a
    run owns them.
    """

    def __init__(self, frames: Mapping[str, DataFrame], staging: Staging | None = None):
        super().__init__(frames)
        self._derived: dict[str, DataFrame] = {}
        self.staging = staging

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = build()
        return self._derived[name]

    def replace(self, name: str, frame: DataFrame) -> None:
        self._derived[name] = frame

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return self.staging.stage(df, name) if self.staging else stage(df, name)

    def forget(self) -> None:
        """Drop what was derived, as after its files were deleted."""
        self._derived.clear()


def load_tables(
    spark: SparkSession, source: str | Mapping, zone: str | None = None
) -> CaseTables:
    """The ten case-file tables.

    `source` is a directory with one Parquet file or folder `<table>.parquet` per table,
    or a mapping for JDBC, see `jdbc_options`. `zone` is needed where times are instants.
    """
    return CaseTables(_load(spark, source, CASE_TABLES, zone))


def load_access_tables(
    spark: SparkSession, source: str | Mapping, zone: str | None = None
) -> dict[str, DataFrame]:
    """The three tables that say who may analyse which organisation."""
    return _load(spark, source, ACCESS_TABLES, zone)


def _load(spark, source, schemas, zone=None):
    return {name: read_table(spark, source, name, ddl, zone) for name, ddl in schemas.items()}


def read_table(
    spark: SparkSession, source: str | Mapping, name: str, ddl: str, zone: str | None = None
) -> DataFrame:
    if not isinstance(source, Mapping):
        path = f"{source}/{name}.parquet"
        stored = {f.name: f.dataType for f in spark.read.parquet(path).schema}
        asked = StructType()
        for f in schema_of(ddl):
            same = isinstance(stored.get(f.name), TimestampNTZType)
            asked.add(f.name, stored[f.name] if same else f.dataType)
        return wall_clock(spark.read.schema(asked).parquet(path), ddl, zone)

    def ask(query: str) -> tuple:
        options = {str(k): str(v) for k, v in source["options"].items()} | {"query": query}
        return tuple(spark.read.format("jdbc").options(**options).load().first())

    options = jdbc_options(source, name, ddl, ask)
    return wall_clock(spark.read.format("jdbc").options(**options).load(), ddl, zone)


def wall_clock(df: DataFrame, ddl: str, zone: str | None) -> DataFrame:
    """The columns of `ddl`; times as the wall clock, in the session's zone (UTC).

    A time without a zone is that already. An instant is moved to `zone`, if one is given.
    """

    def typed(field) -> Column:
        x = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, TimestampType):
            return x
        if zone and not isinstance(df.schema[field.name].dataType, TimestampNTZType):
            x = F.from_utc_timestamp(x, zone)
        return x.cast("timestamp").alias(field.name)

    return df.select(*[typed(f) for f in schema_of(ddl)])


def jdbc_options(
    source: Mapping, table: str, ddl: str, ask: Callable[[str], tuple] | None = None
) -> dict[str, str]:
    """Options of one JDBC read.

    `source["options"]` holds url, driver, user and so on. `source["tables"]` may put
    another name or a subquery with an alias (`(SELECT ...) t`) for a table. The database's
    types are overridden by ours through `customSchema`, times without a zone.

    `source["splits"]` says how a table is read in parallel: a column, whose bounds `ask` then
    takes from the table, or `(column, lower, upper, partitions)`. Tables that grow are split
    by the key in `SPLIT_KEYS` if nothing is said. `None` reads a table in one task, which is
    refused beyond `ROWS_PER_SPLIT` rows. Bounds only place the cuts, no row is left out.
    """
    options = {str(k): str(v) for k, v in source["options"].items()}
    name = source.get("tables", {}).get(table, table)
    options["dbtable"] = name
    options["customSchema"] = ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ")
    options["preferTimestampNTZ"] = "true"
    split = source.get("splits", {}).get(table, SPLIT_KEYS.get(table))
    if isinstance(split, str):
        if ask is None:
            raise ValueError(f"bounds of {table}.{split} are not known")
        split = planned_split(split, ask(bounds_query(name, split)))
    elif split is None and table in SPLIT_KEYS and ask is not None:
        (rows,) = ask(f"SELECT COUNT(*) FROM {name}")
        if rows > ROWS_PER_SPLIT:
            raise ValueError(f"{table} has {rows} rows: name a column to split it by")
    if split:
        column, lower, upper, partitions = split
        options.update(
            partitionColumn=column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return options


def bounds_query(table: str, column: str) -> str:
    return f"SELECT MIN({column}), MAX({column}), COUNT(*) FROM {table}"


def planned_split(
    column: str, bounds: tuple, rows_per_split: int = ROWS_PER_SPLIT
) -> tuple | None:
    """(column, lower, upper, partitions) for the bounds and rows found; `None` if one task is
    enough."""
    least, greatest, rows = bounds
    partitions = -(-int(rows) // rows_per_split)
    if partitions <= 1 or least is None:
        return None
    # More cuts than values would leave tasks without rows.
    span = int(greatest) - int(least) + 1
    partitions = min(partitions, span)
    return (column, int(least), int(greatest) + 1, partitions) if partitions > 1 else None

"""Writing and reading the marts.

Every run writes into a folder of its own under `<path>/runs` and is published at the end
by its entry in `<path>/published`. Readers never see a half-written run, a run that was
cut off is simply started again, and repeating one does not disturb its readers.

Marts that grow are kept in folders by org. The folder's name is a code of the org that no
value is lost in, also not NULL, the empty text or a number; readers take the org from it, so
that a selection opens its folders only. The files hold the org as well, for other tools.

What a run stages for itself is deleted when it ends, see `Staging`.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casestats.functions.dates import moment
from casestats.operators.lookups import share_processes
from casestats.plans.marts import BASE, PROJECTIONS, STEPS, LazyMarts
from casestats.sources.schemas import MARTS, schema_of
from casestats.sources.staging import Staging, delete, folders
from casestats.sources.tables import CaseTables

# Marts that grow with the cases: the org column their readers filter on, and the order
# of rows within a file, by which readers skip parts of it.
PARTITIONED_BY = {
    "stock_movements": "orgao",
    "process_lifetime": "orgao",
    "open_process_control": "orgao_atual",
    "stock_daily": "orgao",
    "lifetime_counts": "orgao",
    "open_activity_rollup": "orgao",
    "open_process_bitmaps": "orgao_atual",
}
# Further folders below the org's, for columns that questions always select by.
THEN_BY = {"open_activity_rollup": ["nivel"]}
SORTED_BY = {
    "stock_movements": ["data", "unidade"],
    "process_lifetime": ["unidade", "tipo_processo"],
    "open_process_control": ["unidade_atual", "tipo_processo"],
    "stock_daily": ["unidade", "tipo_processo", "data"],
    "lifetime_counts": ["unidade", "tipo_processo"],
    "open_activity_rollup": ["unidade_atual", "tipo_processo"],
    "open_process_bitmaps": ["unidade_atual", "tipo_processo"],
}
FOLDER = "pasta"

# Marts written at the same time
SIDE_BY_SIDE = 4


def build_marts(tables: CaseTables, path: str, as_of) -> dict[str, DataFrame]:
    """The daily job: write what several marts share, then all marts."""
    spark = next(iter(tables.values())).sparkSession
    with Staging(spark) as tables.staging:
        try:
            share_processes(tables)
            return write_marts(LazyMarts(tables, as_of), path, as_of)
        finally:
            tables.staging = None
            tables.forget()


def write_marts(
    marts: Mapping[str, DataFrame], path: str, as_of
) -> dict[str, DataFrame]:
    """Write the base marts, then the derived ones out of the files just written.

    Marts that do not read each other are written side by side, so that small ones fill
    the executors a large one leaves idle.
    """
    run = f"runs/{run_name(as_of)}-{uuid.uuid4().hex[:8]}"
    written: dict[str, DataFrame] = {}

    def write(named: tuple[str, DataFrame]) -> None:
        name, df = named
        _write(df, name, f"{path}/{run}/{name}")
        written[name] = _read(df.sparkSession, name, f"{path}/{run}/{name}")

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        list(pool.map(write, [(name, marts[name]) for name in BASE]))
        for step in STEPS:
            _add_projections(written)
            list(pool.map(write, [(f.__name__, f(written)) for f in step]))
    _add_projections(written)
    spark = next(iter(written.values())).sparkSession
    (
        spark.range(1)
        .select(
            moment(as_of).alias("as_of"),
            F.current_timestamp().alias("published_at"),
            F.lit(run).alias("run"),
        )
        .write.mode("append")
        .parquet(f"{path}/published")
    )
    return written


def read_marts(spark: SparkSession, path: str, as_of=None) -> dict[str, DataFrame]:
    """The marts as last published, for the given `as_of` or for the latest one."""
    published = spark.read.parquet(f"{path}/published")
    if as_of is not None:
        published = published.filter(F.col("as_of") == moment(as_of))
    latest = published.orderBy(F.desc("as_of"), F.desc("published_at")).first()
    if latest is None:
        raise ValueError(f"no marts published under {path} for {as_of}")
    marts = {
        name: _read(spark, name, f"{path}/{latest['run']}/{name}")
        for name in MARTS
        if name not in PROJECTIONS
    }
    _add_projections(marts)
    return marts


def expire(spark: SparkSession, path: str, keep: int = 7) -> list[str]:
    """Delete the runs that were written before the latest `keep` published ones; their names.
    A run that is not published yet is younger than those, unless it was cut off."""
    published = spark.read.parquet(f"{path}/published").orderBy(F.desc("published_at"))
    kept = [r.run.removeprefix("runs/") for r in published.limit(keep).collect()]
    if len(kept) < keep or keep < 1:
        return []
    oldest = published.limit(keep).agg(F.min("published_at")).first()[0]
    known = {r.run.removeprefix("runs/") for r in published.collect()}
    gone = []
    for name in folders(spark, f"{path}/runs"):
        young = name not in known and _written_at(spark, f"{path}/runs/{name}") >= oldest
        if name not in kept and not young:
            delete(spark, f"{path}/runs/{name}")
            gone.append(name)
    return gone


def run_name(as_of) -> str:
    """`as_of` as part of a folder name."""
    stamp = str(as_of)[:19].translate(str.maketrans({" ": "T", ":": "-"}))
    return stamp if "T" in stamp else f"{stamp}T00-00-00"


def folder_code(org: Column) -> Column:
    """The org as a folder's name: never NULL or empty, and never taken for a number."""
    return F.coalesce(F.concat(F.lit("v"), org), F.lit("n"))


def folder_org(code: Column) -> Column:
    return F.when(code != "n", F.substring(code, 2, 2**31 - 1))


def _add_projections(marts: dict[str, DataFrame]) -> None:
    for name, (source, project) in PROJECTIONS.items():
        if source in marts:
            marts[name] = project(marts)


def _write(df: DataFrame, name: str, folder: str) -> None:
    org = PARTITIONED_BY.get(name)
    if org is None:
        df.write.parquet(folder)
        return
    # Rebalancing gathers an org's rows into full files and cuts a large org into several
    # tasks by the size seen at run time.
    (
        df.withColumn(FOLDER, folder_code(F.col(org)))
        .hint("rebalance", FOLDER)
        .sortWithinPartitions(FOLDER, *THEN_BY.get(name, []), *SORTED_BY[name])
        .write
        .partitionBy(FOLDER, *THEN_BY.get(name, []))
        .parquet(folder)
    )


def _read(spark: SparkSession, name: str, folder: str) -> DataFrame:
    schema = schema_of(MARTS[name])
    org = PARTITIONED_BY.get(name)
    if org is None:
        return spark.read.schema(schema).parquet(folder)
    stored = schema_of(MARTS[name]).add(FOLDER, "string")
    df = spark.read.schema(stored).parquet(folder)
    return df.select(
        *[folder_org(F.col(FOLDER)).alias(c) if c == org else c for c in schema.fieldNames()]
    )


def _written_at(spark: SparkSession, folder: str):
    """When a folder was last changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    seconds = fs.getFileStatus(path).getModificationTime() / 1000
    return dt.datetime.fromtimestamp(seconds)

"""Landing: each source table is read once and kept as files that all marts start from.

A live database changes while it is read. Read several times, the marts of one run would
contradict each other; landed once, they agree, and a mart can be built again from the same
rows. Rows refer to rows that are older, so tables are read before those they refer to: no
landed activity lacks its process, unless rows are deleted meanwhile.

The manifest tells for every table when it was read and what it holds. A landing that was cut
off goes on under the same name with the tables that are not in it yet, and counts once all
tables are.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestats.functions.digest import DIGEST, table_digest
from casestats.sources.schemas import ACCESS_TABLES, CASE_TABLES, schema_of
from casestats.sources.staging import delete, folders
from casestats.sources.tables import CaseTables, read_table

MANIFEST = f"pouso STRING, tabela STRING, lido_de TIMESTAMP, lido_ate TIMESTAMP, {DIGEST}"

# What refers to other tables is read before them; tables of one step side by side.
READ_ORDER = [
    ["atividade", "anexo", "documento_conteudo", "permissao"],
    ["documento", "procedimento", "auth"],
    ["protocolo"],
    ["usuario", "unidade", "tipo_procedimento", "acesso_orgao"],
    ["orgao"],
]


def land(
    spark: SparkSession,
    source: str | Mapping,
    path: str,
    zone: str | None = None,
    run: str | None = None,
    schemas: Mapping[str, str] = CASE_TABLES,
) -> str:
    """Copy the tables of `source` (see `load_tables`) under `path`; the landing's name."""
    run = run or f"{dt.datetime.now(dt.UTC):%Y-%m-%dT%H-%M-%S}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/{run}"
    done = _landed_tables(spark, folder)

    def copy(name: str) -> None:
        ddl = schemas[name]
        began = dt.datetime.now(dt.UTC)
        rows = read_table(spark, source, name, ddl, zone)
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        ended = dt.datetime.now(dt.UTC)
        digest = table_digest(_table(spark, folder, name, ddl))
        digest.select(
            F.lit(run).alias("pouso"),
            F.lit(name).alias("tabela"),
            F.lit(began.isoformat()).cast("timestamp").alias("lido_de"),
            F.lit(ended.isoformat()).cast("timestamp").alias("lido_ate"),
            "*",
        ).write.mode("overwrite").parquet(f"{folder}/manifest/{name}")

    for step in READ_ORDER:
        missing = [name for name in step if name in schemas and name not in done]
        with ThreadPoolExecutor(max(1, len(missing))) as pool:
            list(pool.map(copy, missing))
    return run


def land_access(spark: SparkSession, source, path: str, zone=None, run=None) -> str:
    """The same for the access tables."""
    return land(spark, source, path, zone, run, ACCESS_TABLES)


def manifest(spark: SparkSession, path: str, run: str) -> DataFrame:
    """When each table was read, and its digest; see `MANIFEST`."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/{run}/manifest/*")


def load_landed(spark: SparkSession, path: str, run: str | None = None) -> CaseTables:
    """The tables of one landing, or of the latest complete one."""
    run = run or _latest(spark, path, CASE_TABLES)
    return CaseTables(_load(spark, path, run, CASE_TABLES))


def load_landed_access(
    spark: SparkSession, path: str, run: str | None = None
) -> dict[str, DataFrame]:
    run = run or _latest(spark, path, ACCESS_TABLES)
    return _load(spark, path, run, ACCESS_TABLES)


def differences(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(tabela, coluna) whose files no longer hold what the manifest says. Empty if whole."""
    told = manifest(spark, path, run).drop("pouso", "lido_de", "lido_ate")
    names = [r.tabela for r in told.select("tabela").distinct().collect()]
    found = None
    for name in names:
        ddl = (CASE_TABLES | ACCESS_TABLES)[name]
        own = table_digest(_table(spark, f"{path}/{run}", name, ddl))
        own = own.select(F.lit(name).alias("tabela"), "*")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return told.select("tabela", "coluna")
    return told.exceptAll(found).unionByName(found.exceptAll(told)).select("tabela", "coluna").distinct()


def expire(spark: SparkSession, path: str, keep: int = 7, schemas=CASE_TABLES) -> list[str]:
    """Delete the landings older than the latest `keep` complete ones; their names. One that
    may still be going on is younger than those."""
    runs = _runs(spark, path)
    complete = [run for run, tables in runs if set(schemas) <= tables]
    if len(complete) < keep or keep < 1:
        return []
    names = [run for run, _ in runs]
    gone = names[: names.index(complete[-keep])]
    for run in gone:
        delete(spark, f"{path}/{run}")
    return gone


def _table(spark, folder, name, ddl):
    return spark.read.schema(schema_of(ddl)).parquet(f"{folder}/{name}.parquet")


def _load(spark, path, run, schemas):
    missing = sorted(set(schemas) - _landed_tables(spark, f"{path}/{run}"))
    if missing:
        raise ValueError(f"landing {run} is not complete: {', '.join(missing)}")
    return {name: _table(spark, f"{path}/{run}", name, ddl) for name, ddl in schemas.items()}


def _latest(spark, path, schemas):
    for run, tables in reversed(_runs(spark, path)):
        if set(schemas) <= tables:
            return run
    raise ValueError(f"no complete landing under {path}")


def _runs(spark, path):
    """(name, tables) of all landings, in the order in which they were last added to."""
    begun = [run for run in folders(spark, path) if folders(spark, f"{path}/{run}/manifest")]
    if not begun:
        return []
    found = (
        spark.read.schema(MANIFEST).parquet(*[f"{path}/{run}/manifest/*" for run in begun])
        .groupBy("pouso")
        .agg(F.max("lido_ate").alias("fim"), F.collect_set("tabela").alias("tabelas"))
        .orderBy("fim", "pouso")
    )
    return [(r.pouso, set(r.tabelas)) for r in found.collect()]


def _landed_tables(spark, folder):
    if not folders(spark, f"{folder}/manifest"):
        return set()
    told = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/*")
    return {r.tabela for r in told.select("tabela").distinct().collect()}

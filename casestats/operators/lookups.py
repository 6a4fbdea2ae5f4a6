"""Names for ids, and the frames that several marts start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestats.fixed_values import PROCESS
from casestats.sources.tables import CaseTables

MAX_LOOKUP_ROWS = 200_000

# Texts of a process, which only lists of open processes show.
TEXTS = ["protocolo_formatado", "descricao"]


def small_side(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Mark `df` for broadcast if it is counted to be within `max_rows`.

    Beyond that it stays as it is, and Spark shuffles both sides of the join.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def unit_names(tables: CaseTables) -> DataFrame:
    """(id_unidade, orgao, unidade); a unit without organisation is left out."""

    def build():
        orgs = tables["orgao"].select("id_orgao", F.col("sigla").alias("orgao"))
        units = tables["unidade"].select(
            "id_unidade", "id_orgao", F.col("sigla").alias("unidade")
        )
        return small_side(units.join(orgs, "id_orgao").drop("id_orgao"))

    return tables.derived("unit_names", build)


def current_unit_names(tables: CaseTables) -> DataFrame:
    """(id_unidade, orgao_atual, unidade_atual); a unit without organisation is kept."""

    def build():
        orgs = tables["orgao"].select("id_orgao", F.col("sigla").alias("orgao_atual"))
        units = tables["unidade"].select(
            "id_unidade", "id_orgao", F.col("sigla").alias("unidade_atual")
        )
        return small_side(units.join(orgs, "id_orgao", "left").drop("id_orgao"))

    return tables.derived("current_unit_names", build)


def type_names(tables: CaseTables) -> DataFrame:
    def build():
        return small_side(
            tables["tipo_procedimento"].select(
                "id_tipo_procedimento", F.col("nome").alias("tipo_processo")
            )
        )

    return tables.derived("type_names", build)


def with_unit(df: DataFrame, tables: CaseTables, unit_id: str) -> DataFrame:
    """Replace a unit id by `orgao` and `unidade`."""
    names = unit_names(tables).withColumnRenamed("id_unidade", unit_id)
    return df.join(names, unit_id).drop(unit_id)


def with_current_unit(df: DataFrame, tables: CaseTables, unit_id: str) -> DataFrame:
    names = current_unit_names(tables).withColumnRenamed("id_unidade", unit_id)
    return df.join(names, unit_id, "left").drop(unit_id)


def with_type(df: DataFrame, tables: CaseTables) -> DataFrame:
    """Replace the type id by `tipo_processo`."""
    return df.join(type_names(tables), "id_tipo_procedimento").drop("id_tipo_procedimento")


def processes(tables: CaseTables) -> DataFrame:
    """Registered items that are processes and have a header, with the header's type id."""

    def build():
        items = tables["protocolo"].filter(F.col("sta_protocolo") == PROCESS)
        headers = tables["procedimento"].select(
            F.col("id_procedimento").alias("id_protocolo"), "id_tipo_procedimento"
        )
        return items.drop("sta_protocolo").join(headers, "id_protocolo")

    return tables.derived("processes", build)


def activity_summary(tables: CaseTables) -> DataFrame:
    """Per item: whether an activity is open (`aberto`), and the conclusion of the one with
    the greatest id (`ultima_conclusao`).

    One pass over the activities. They are combined per item before the shuffle, so an item
    with very many of them is no heavier than others.
    """
    return (
        tables["atividade"]
        .groupBy("id_protocolo")
        .agg(
            F.max_by("dth_conclusao", "id_atividade").alias("ultima_conclusao"),
            F.bool_or(F.col("dth_conclusao").isNull()).alias("aberto"),
            F.lit(True).alias("tramitado"),
        )
    )


def followed_processes(tables: CaseTables) -> DataFrame:
    """`processes` with the summary of their activities, if there are any (`tramitado`).
    Written once, without their texts: see `with_texts`.

    Activities of one process may be a large part of all activities. Against a written
    table their join shuffles both sides directly, so adaptive execution can split that
    process over many tasks.
    """

    def build():
        narrow = processes(tables).drop(*TEXTS)
        followed = narrow.join(activity_summary(tables), "id_protocolo", "left")
        return tables.stage(followed, "processes")

    return tables.derived("followed_processes", build)


def open_processes(tables: CaseTables) -> DataFrame:
    """Processes with at least one open activity."""
    return followed_processes(tables).filter("aberto")


def with_texts(cases: DataFrame, tables: CaseTables) -> DataFrame:
    """`cases` with the number and description of their processes."""
    texts = tables["protocolo"].filter(F.col("sta_protocolo") == PROCESS)
    return cases.join(texts.select("id_protocolo", *TEXTS), "id_protocolo")


def share_processes(tables: CaseTables) -> None:
    """Let marts that need no activities start from the written processes too."""
    tables.replace("processes", followed_processes(tables))

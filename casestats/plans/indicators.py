"""General indicators. Each reads marts and a selection of org and unit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestats.fixed_values import (
    ALL_ORGS,
    ALL_UNITS,
    ASSIGNEE_HEADERS,
    ASSIGNEE_HEADERS_ALL,
    LIFETIME_HEADERS,
)
from casestats.functions.stats import median_of
from casestats.functions.text import deviation_label
from casestats.operators.filters import (
    assigned_only,
    drop_wildcard_unit,
    named_assignee,
    scope,
)
from casestats.operators.options import prepend_all

Marts = Mapping[str, DataFrame]


def open_process_count(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    """Open activities in scope: a process open in three units counts three times."""
    rows = scope(marts["days_in_unit_totals"], orgao, unidade, unit_col="unidade_atual")
    return rows.agg(F.coalesce(F.sum("atividades"), F.lit(0)).alias("total"))


def registered_users(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    """Active users of the org. Users have no unit, so the unit is not looked at."""
    rows = scope(marts["active_users_by_org"], orgao)
    return rows.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def median_lifetime(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    return (
        scope(marts["lifetime_counts"], orgao, unidade)
        .groupBy("tempo_vida")
        .agg(F.sum("processos").alias("processos"))
        .agg(median_of("tempo_vida", "processos").alias("mediana"))
    )


def top_process_types(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    """Filings by type with their share of the total, between 0 and 1."""
    by_type = (
        scope(marts["process_types_by_org_unit"], orgao, unidade)
        .groupBy("tipo_processo")
        .agg(F.sum("total").alias("total"))
    )
    everything = F.sum("total").over(Window.partitionBy())
    return by_type.withColumn("participacao", F.col("total") / everything).orderBy(
        F.desc("total"), "tipo_processo"
    )


def pages_saved_total(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    rows = scope(marts["pages_saved"], orgao, unidade)
    return rows.agg(F.bround(F.coalesce(F.sum("soma"), F.lit(0.0)), 0).alias("folhas"))


def weekly_evolution(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    return (
        scope(marts["weekly_filings"], orgao, unidade)
        .groupBy("inicio", "intervalo")
        .agg(F.sum("total").alias("total"))
        .orderBy("inicio")
        .select("intervalo", "total")
    )


def unit_options(marts: Marts, orgao: str = ALL_ORGS) -> DataFrame:
    """Units where processes are now. Over all orgs, a name used by two appears twice."""
    units = scope(marts["current_unit_options"], orgao, org_col="orgao_atual")
    return prepend_all(
        drop_wildcard_unit(units, "unidade_atual").select("unidade_atual"), ALL_UNITS
    )


def lifetime_by_type(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS, *, headers: bool = False
) -> DataFrame:
    """Median lifetime by type; with a selection, how far it is off the overall median.
    `headers` names the columns as the screen does."""
    overall = marts["lifetime_median_by_type"]
    if orgao == ALL_ORGS and unidade == ALL_UNITS:
        ordered = overall.orderBy(F.desc("mediana"), "tipo_processo")
        return _titled(ordered, LIFETIME_HEADERS, headers)
    scoped = (
        scope(marts["lifetime_counts"], orgao, unidade)
        .groupBy("tipo_processo", "tempo_vida")
        .agg(F.sum("processos").alias("processos"))
        .groupBy("tipo_processo")
        .agg(median_of("tempo_vida", "processos").alias("mediana"))
    )
    compared = _against_overall(marts, scoped, overall, ["tipo_processo"]).select(
        "tipo_processo", "mediana", "desvio"
    )
    return _titled(compared, LIFETIME_HEADERS, headers)


def assignee_time(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS, *, headers: bool = False
) -> DataFrame:
    """Median days in the unit by assignee and type, over assigned open activities. `headers`
    names the columns as the screen does."""
    whole = orgao == ALL_ORGS and unidade == ALL_UNITS
    keys = ["atribuido", "tipo_processo"]
    medians = (
        scope(marts["days_in_unit_counts"], orgao, unidade, unit_col="unidade_atual")
        .filter(assigned_only() if whole else named_assignee())
        .groupBy(*keys, "dias_unidade")
        .agg(F.sum("atividades").alias("atividades"))
        .groupBy(*keys)
        .agg(median_of("dias_unidade", "atividades").alias("mediana"))
    )
    if whole:
        return _titled(medians.orderBy(F.desc("mediana"), *keys), ASSIGNEE_HEADERS_ALL, headers)
    overall = marts["days_in_unit_median_by_type"]
    compared = _against_overall(marts, medians, overall, keys).select(*keys, "mediana", "desvio")
    return _titled(compared, ASSIGNEE_HEADERS, headers)


def _titled(df: DataFrame, titles: Mapping[str, str], wanted: bool) -> DataFrame:
    return df.withColumnsRenamed(titles) if wanted else df


def _against_overall(marts, scoped, overall, keys):
    """Label each median. The lower bound of "expected" is the first quartile of all
    lifetimes, for days in a unit too."""
    quartile = marts["lifetime_first_quartile"].scalar()
    median, general = F.col("mediana"), F.col("mediana_geral")
    return (
        scoped.join(overall.withColumnRenamed("mediana", "mediana_geral"), "tipo_processo")
        .withColumn("desvio", deviation_label(median, general, quartile))
        .orderBy(median - general, *keys)
    )

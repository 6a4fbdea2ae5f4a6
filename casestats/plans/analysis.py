"""Distribution of lifetimes by process type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestats.fixed_values import ALL_ORGS, ALL_UNITS
from casestats.functions.stats import quartiles_of
from casestats.operators.filters import scope

Marts = Mapping[str, DataFrame]
WHISKER = 1.5


def lifetime_distribution(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    """The lifetimes in scope, a row per process."""
    return scope(marts["process_lifetime"], orgao, unidade)


def lifetime_boxes(
    marts: Marts, orgao: str = ALL_ORGS, unidade: str = ALL_UNITS
) -> DataFrame:
    """One box per type: quartiles, whiskers at the furthest lifetimes within 1.5
    interquartile ranges, and how many lie outside."""
    counted = (
        scope(marts["lifetime_counts"], orgao, unidade)
        .groupBy("tipo_processo", "tempo_vida")
        .agg(F.sum("processos").alias("processos"))
    )
    boxes = (
        counted.groupBy("tipo_processo")
        .agg(
            quartiles_of("tempo_vida", "processos").alias("q"),
            F.min("tempo_vida").alias("minimo"),
            F.max("tempo_vida").alias("maximo"),
            F.sum("processos").alias("processos"),
        )
        .select(
            "tipo_processo",
            "processos",
            "minimo",
            F.col("q")[0].alias("q1"),
            F.col("q")[1].alias("mediana"),
            F.col("q")[2].alias("q3"),
            "maximo",
        )
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col("tempo_vida").between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = (
        counted.join(boxes.select("tipo_processo", "q1", "q3"), "tipo_processo")
        .groupBy("tipo_processo")
        .agg(
            F.min(F.when(inside, F.col("tempo_vida"))).alias("haste_inferior"),
            F.max(F.when(inside, F.col("tempo_vida"))).alias("haste_superior"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("processos"))).alias("discrepantes"),
        )
    )
    return boxes.join(whiskers, "tipo_processo").orderBy("tipo_processo")

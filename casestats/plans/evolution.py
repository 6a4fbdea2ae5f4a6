"""Evolution of the project: filings by week and month, and rankings against paper.

Paper counts come from outside: a frame (orgao, data, papel) with the number of paper
filings of an org on a day.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestats import fixed_values as fixed
from casestats.functions.dates import day, month_start, week_start

Marts = Mapping[str, DataFrame]


def project_weekly(marts: Marts, start=None, end=None) -> DataFrame:
    """Filings of all orgs by week, up to the last complete week. A range shows the week of
    its first day to the week of its last."""
    weeks = marts["weekly_history"]
    if start is not None:
        weeks = weeks.filter(F.col("inicio") >= week_start(start))
    if end is not None:
        weeks = weeks.filter(F.col("inicio") <= day(end))
    return (
        weeks.groupBy("ano", "semana", "inicio", "fim", "intervalo")
        .agg(F.sum("total").alias("total"))
        .orderBy("inicio")
    )


def project_monthly(marts: Marts, start=fixed.PROJECT_START, end=None) -> DataFrame:
    """Filings of all orgs by month, from the month of `start` to the month of `end`."""
    month = F.make_date("ano", "mes", F.lit(1))
    shown = marts["monthly_filings"].filter(month >= month_start(start))
    if end is not None:
        shown = shown.filter(month <= day(end))
    return (
        shown.groupBy("ano", "mes", "periodo")
        .agg(F.sum("total").alias("total"))
        .orderBy("ano", "mes")
    )


def migration_ranking_weekly(
    marts: Marts, paper: DataFrame, as_of, minimum: int = fixed.MIN_WEEKLY_FILINGS
) -> DataFrame:
    """Orgs by electronic against paper filings in the last complete week."""
    end = week_start(as_of)
    start = F.date_sub(end, 7)
    electronic = marts["weekly_history"].filter(F.col("inicio") == start)
    return _ranking(electronic, paper, start, end, minimum)


def migration_ranking_monthly(
    marts: Marts, paper: DataFrame, as_of, minimum: int = fixed.MIN_MONTHLY_FILINGS
) -> DataFrame:
    """The same for the last complete month."""
    end = month_start(as_of)
    start = F.add_months(end, -1)
    electronic = marts["monthly_filings"].filter(
        (F.col("ano") == F.year(start)) & (F.col("mes") == F.month(start))
    )
    return _ranking(electronic, paper, start, end, minimum)


def _ranking(electronic, paper, start, end, minimum):
    """An org needs `minimum` filings of either kind. One without paper has no quotient
    and comes first. The window holds a row per org."""
    none = F.lit(0).cast("bigint")
    filings = electronic.select(
        "orgao", F.col("total").alias("eletronico"), none.alias("papel")
    ).unionByName(
        paper.filter((F.col("data") >= start) & (F.col("data") < end)).select(
            "orgao", none.alias("eletronico"), F.col("papel").cast("bigint").alias("papel")
        )
    )
    quotient = F.try_divide("eletronico", "papel")
    return (
        filings.groupBy("orgao")
        .agg(F.sum("eletronico").alias("eletronico"), F.sum("papel").alias("papel"))
        .filter(F.col("eletronico") + F.col("papel") >= minimum)
        .withColumn("proporcao", quotient)
        .withColumn(
            "posicao",
            F.rank().over(Window.orderBy(F.desc_nulls_first("proporcao"))).cast("bigint"),
        )
        .orderBy("posicao", "orgao")
    )

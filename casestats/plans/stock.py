"""Stock control: movements in and out of units, running balance, open processes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestats.fixed_values import (
    ALL_ORGS,
    ALL_TYPES,
    ALL_UNITS,
    ENTRADA,
    EXPORT_HEADERS,
    SAIDA,
    TABLE_HEADERS,
)
from casestats.functions.dates import day, month_start
from casestats.operators.filters import between_dates, drop_wildcard_unit, scope, scope_current
from casestats.operators.options import prepend_all

Marts = Mapping[str, DataFrame]


def stock_unit_options(marts: Marts, orgao: str = ALL_ORGS) -> DataFrame:
    units = drop_wildcard_unit(scope(marts["stock_units"], orgao), "unidade")
    return prepend_all(units.select("unidade"), ALL_UNITS)


def type_options(marts: Marts) -> DataFrame:
    return prepend_all(marts["stock_daily"].select("tipo_processo").distinct(), ALL_TYPES)


def default_period(clock: DataFrame, as_of="as_of") -> DataFrame:
    """First day of the current month to today, for each row of a frame with the time."""
    now = F.col(as_of)
    return clock.select(month_start(now).alias("inicio"), day(now).alias("fim"))


def stock_flow(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    start,
    end,
    subunits: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Quantity by day and direction."""
    moves = marts["stock_daily"]
    return (
        _moves(marts, moves, orgao, unidade, tipo, subunits=subunits, literal=literal)
        .filter(between_dates("data", start, end))
        .groupBy("data", "atividade")
        .agg(F.sum("qtde").alias("qtde"))
        .orderBy("data", "atividade")
    )


def stock_balance(marts: Marts, *selection, by: Sequence[str] = (), **options) -> DataFrame:
    """Net movement and stock by day; the first day carries the opening balance.

    `by` (for instance `["orgao", "unidade"]`) gives one series per group in one job.
    """
    return _daily_balance(marts, *selection, by=by, **options).select(
        *by, "data", "estoque_diario", "estoque"
    )


def stock_chart(marts: Marts, *selection, by: Sequence[str] = (), **options) -> DataFrame:
    """In, out and stock by day. A direction without movement on a day is NULL."""
    return _daily_balance(marts, *selection, by=by, **options).select(
        *by, "data", F.col("entrada"), F.col("saida"), "estoque"
    )


def _daily_balance(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    start,
    end,
    subunits: bool = False,
    literal: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """All days before `start` fold into one opening bucket, dated the day before.

    The window runs over sums by day: at most one row per day and group.
    """
    first, direction, qtde = day(start), F.col("atividade"), F.col("qtde")
    moves = _moves(
        marts, marts["stock_daily"], orgao, unidade, tipo, subunits=subunits, literal=literal
    ).filter(F.col("data") <= day(end))
    daily = moves.groupBy(
        *by, F.greatest("data", F.date_sub(first, 1)).alias("data")
    ).agg(
        F.sum(F.when(direction == ENTRADA, qtde)).alias("entrada"),
        F.sum(F.when(direction == SAIDA, qtde)).alias("saida"),
        F.sum(F.when(direction == ENTRADA, qtde).otherwise(-qtde)).alias("liquido"),
    )
    days = Window.partitionBy(*by).orderBy("data")
    so_far = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("data").over(days)
    return (
        daily.withColumn("estoque", F.sum("liquido").over(so_far))
        .withColumn("carrega", before.isNull() | (before < first))
        .filter(F.col("data") >= first)
        .withColumn(
            "estoque_diario",
            F.when(F.col("carrega"), F.col("estoque")).otherwise(F.col("liquido")),
        )
        .orderBy(*by, "data")
    )


def open_process_table(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    subunits: bool = False,
    literal: bool = False,
    headers: bool = False,
) -> DataFrame:
    """Open activities by where they are now."""
    rows = _held(
        marts, marts["open_process_summary"], orgao, unidade, tipo, subunits=subunits, literal=literal
    )
    return _columns(rows, TABLE_HEADERS, headers)


def open_process_export(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    subunits: bool = False,
    literal: bool = False,
    headers: bool = True,
) -> DataFrame:
    rows = _held(
        marts, marts["open_process_control"], orgao, unidade, tipo, subunits=subunits, literal=literal
    )
    return _columns(rows, EXPORT_HEADERS, headers)


def stock_distinct_total(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    subunits: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Processes in scope, each once: the sets of the places in scope are united."""
    sets = _held(
        marts, marts["open_process_bitmaps"], orgao, unidade, tipo, subunits=subunits, literal=literal
    )
    return (
        sets.groupBy("balde")
        .agg(F.bitmap_count(F.bitmap_or_agg("mapa")).alias("processos"))
        .agg(F.coalesce(F.sum("processos"), F.lit(0)).alias("total"))
    )


def stock_export(
    marts: Marts,
    orgao: str = ALL_ORGS,
    unidade: str = ALL_UNITS,
    tipo: str = ALL_TYPES,
    *,
    start,
    end,
    subunits: bool = False,
    literal: bool = False,
) -> DataFrame:
    """Movement rows of the period."""
    return _moves(
        marts, marts["stock_movements"], orgao, unidade, tipo, subunits=subunits, literal=literal
    ).filter(between_dates("data", start, end))


def _moves(marts, rows, *selection, **options) -> DataFrame:
    """`scope` by the unit of a movement."""
    return scope(rows, *selection, units=marts.get("stock_units"), **options)


def _held(marts, rows, *selection, **options) -> DataFrame:
    """`scope` by where a process is now."""
    return scope_current(rows, *selection, units=marts.get("current_unit_options"), **options)


def _columns(rows: DataFrame, names: Mapping[str, str], headers: bool) -> DataFrame:
    return rows.select(*[F.col(c).alias(h if headers else c) for c, h in names.items()])

"""Mart builders.

Base marts are built from the source tables and `as_of`, derived marts from other marts.
Rows are counted by id before names are attached, so what is shuffled or joined to a
lookup is already small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestats import fixed_values as fixed
from casestats.functions.dates import (
    days_between,
    moment,
    period_label,
    short_date,
    sunday_number,
    week_label,
    week_start,
)
from casestats.functions.stats import median_of, quantile_of
from casestats.operators.lookups import (
    followed_processes,
    open_processes,
    processes,
    with_current_unit,
    with_texts,
    with_type,
    with_unit,
)
from casestats.sources.schemas import MARTS
from casestats.sources.tables import CaseTables


def rows() -> Column:
    return F.count(F.lit(1))


# Base marts


def active_orgs(tables: CaseTables, as_of=None) -> DataFrame:
    return (
        tables["orgao"]
        .filter(F.col("sin_ativo") == fixed.ACTIVE)
        .select("sigla")
        .orderBy("sigla")
    )


def processes_by_org_unit(tables: CaseTables, as_of=None) -> DataFrame:
    by_unit = (
        tables["protocolo"]
        .filter(F.col("sta_protocolo") == fixed.PROCESS)
        .groupBy("id_unidade_geradora")
        .agg(rows().alias("total"))
    )
    return (
        with_unit(by_unit, tables, "id_unidade_geradora")
        .groupBy("orgao", "unidade")
        .agg(F.sum("total").alias("total"))
    )


def active_users_by_org(tables: CaseTables, as_of=None) -> DataFrame:
    by_org = (
        tables["usuario"]
        .filter(F.col("sin_ativo") == fixed.ACTIVE)
        .groupBy("id_orgao")
        .agg(rows().alias("total"))
    )
    orgs = tables["orgao"].select("id_orgao", F.col("sigla").alias("orgao"))
    return by_org.join(orgs, "id_orgao").groupBy("orgao").agg(F.sum("total").alias("total"))


def distinct_process_types(tables: CaseTables, as_of=None) -> DataFrame:
    """Type names in use by any registered item, process or not."""
    used = (
        tables["procedimento"]
        .withColumnRenamed("id_procedimento", "id_protocolo")
        .join(tables["protocolo"].select("id_protocolo"), "id_protocolo", "left_semi")
        .select("id_tipo_procedimento")
        .distinct()
    )
    return with_type(used, tables).agg(F.countDistinct("tipo_processo").alias("total"))


def process_types_by_org_unit(tables: CaseTables, as_of=None) -> DataFrame:
    by_id = (
        processes(tables)
        .groupBy("id_unidade_geradora", "id_tipo_procedimento")
        .agg(rows().alias("total"))
    )
    return (
        with_type(with_unit(by_id, tables, "id_unidade_geradora"), tables)
        .groupBy("orgao", "unidade", "tipo_processo")
        .agg(F.sum("total").alias("total"))
        .orderBy("orgao", F.desc("total"), "unidade", "tipo_processo")
    )


def weekly_filings(
    tables: CaseTables,
    as_of,
    weeks: int | None = fixed.WEEKS_SHOWN,
    months: Sequence[str] | None = None,
) -> DataFrame:
    """Processes created in the last complete weeks, Sunday to Saturday.

    `weeks=None` goes back to the first process.
    """
    this_week = week_start(as_of)
    created = F.col("dta_geracao")
    recent = processes(tables).filter(created < this_week.cast("timestamp"))
    if weeks is not None:
        oldest = F.date_sub(this_week, 7 * weeks)
        recent = recent.filter(created >= oldest.cast("timestamp"))
    by_id = recent.groupBy(
        "id_unidade_geradora", "id_tipo_procedimento", week_start(created).alias("inicio")
    ).agg(rows().alias("total"))
    inicio, fim = F.col("inicio"), F.date_add("inicio", 6)
    return (
        with_type(with_unit(by_id, tables, "id_unidade_geradora"), tables)
        .groupBy("orgao", "unidade", "inicio")
        .agg(F.sum("total").alias("total"))
        .select(
            "orgao",
            "unidade",
            F.year(inicio).alias("ano"),
            sunday_number(inicio).alias("semana"),
            "inicio",
            fim.alias("fim"),
            week_label(inicio, fim, months).alias("intervalo"),
            "total",
        )
    )


def weekly_history(tables: CaseTables, as_of) -> DataFrame:
    return weekly_filings(tables, as_of, weeks=None)


def monthly_filings(tables: CaseTables, as_of=None) -> DataFrame:
    by_id = (
        processes(tables)
        .groupBy(
            "id_unidade_geradora",
            "id_tipo_procedimento",
            F.to_date(F.trunc("dta_geracao", "month")).alias("inicio"),
        )
        .agg(rows().alias("total"))
    )
    inicio = F.col("inicio")
    return (
        with_type(with_unit(by_id, tables, "id_unidade_geradora"), tables)
        .groupBy("orgao", "inicio")
        .agg(F.sum("total").alias("total"))
        .select(
            "orgao",
            F.year(inicio).alias("ano"),
            F.month(inicio).alias("mes"),
            period_label(inicio).alias("periodo"),
            "total",
        )
    )


def stock_movements(tables: CaseTables, as_of=None) -> DataFrame:
    """Entries and exits of processes that are open somewhere, by day and process.

    The join leaves the rows partitioned by process, and the process is one of the
    grouping keys: counting needs no further shuffle.
    """
    task = F.col("id_tarefa")
    moves = (
        tables["atividade"]
        .filter(task.isin(*fixed.TASKS_IN, *fixed.TASKS_OUT))
        .select("id_protocolo", "id_unidade", "id_tarefa", F.to_date("dth_abertura").alias("data"))
    )
    direction = F.when(task.isin(*fixed.TASKS_IN), fixed.ENTRADA).otherwise(fixed.SAIDA)
    still_open = open_processes(tables).select("id_protocolo", "id_tipo_procedimento")
    named = with_type(
        with_unit(moves.join(still_open, "id_protocolo"), tables, "id_unidade"), tables
    )
    return named.groupBy(
        "orgao",
        "unidade",
        "tipo_processo",
        direction.alias("atividade"),
        "data",
        F.col("id_protocolo").alias("protocolo"),
    ).agg(rows().alias("qtde"))


def open_process_control(tables: CaseTables, as_of) -> DataFrame:
    """One row per open activity: where the process came from, where it is, how long.

    Assignees join the narrow activity rows and creators the processes, so the wide
    process columns are not carried through the user joins once per activity.
    """
    now = moment(as_of)
    level = F.col("sta_nivel_acesso_global")
    access = reduce(
        lambda case, entry: case.when(level == entry[0], entry[1]),
        fixed.ACCESS_LEVELS.items(),
        F,
    )
    created = F.to_date("dta_geracao")

    users = tables["usuario"]
    creators = users.select(
        F.col("id_usuario").alias("id_usuario_gerador"), F.col("nome").alias("usuario")
    )
    assignees = users.select(
        F.col("id_usuario").alias("id_usuario_atribuicao"), F.col("nome").alias("atribuido")
    )
    waiting = (
        tables["atividade"]
        .filter(F.col("dth_conclusao").isNull())
        .select(
            "id_protocolo",
            F.col("id_unidade").alias("id_unidade_atual"),
            "id_usuario_atribuicao",
            days_between(F.col("dth_abertura"), now).alias("dias_unidade"),
        )
        .join(assignees, "id_usuario_atribuicao", "left")
        .drop("id_usuario_atribuicao")
    )
    cases = with_texts(open_processes(tables), tables).join(creators, "id_usuario_gerador")
    held = waiting.join(cases, "id_protocolo")
    held = with_type(with_unit(held, tables, "id_unidade_geradora"), tables)
    return with_current_unit(held, tables, "id_unidade_atual").select(
        "orgao",
        "unidade",
        F.col("protocolo_formatado").alias("num_processo"),
        F.year(created).alias("ano"),
        F.month(created).alias("mes"),
        F.dayofmonth(created).alias("dia"),
        "usuario",
        "tipo_processo",
        access.alias("nivel_acesso"),
        "descricao",
        "unidade_atual",
        "orgao_atual",
        "dias_unidade",
        days_between(F.col("dta_geracao"), now).alias("tempo_vida"),
        "atribuido",
        short_date(created).alias("data"),
        created.alias("data_filtro"),
    )


def process_lifetime(tables: CaseTables, as_of) -> DataFrame:
    """Days from creation to the conclusion of the activity with the greatest id."""
    end = F.coalesce("ultima_conclusao", moment(as_of))
    lived = (
        followed_processes(tables)
        .filter("tramitado")
        .select(
            "id_unidade_geradora",
            "id_tipo_procedimento",
            days_between(F.col("dta_geracao"), end).alias("tempo_vida"),
        )
    )
    return with_type(with_unit(lived, tables, "id_unidade_geradora"), tables).select(
        "orgao", "unidade", "tipo_processo", "tempo_vida"
    )


def external_pages(tables: CaseTables, as_of=None) -> DataFrame:
    by_unit = (
        tables["anexo"]
        .groupBy("id_unidade")
        .agg(F.sum(F.col("tamanho").cast("bigint")).alias("bytes"))
    )
    return _pages(with_unit(by_unit, tables, "id_unidade"), fixed.KB_PER_EXTERNAL_PAGE)


def internal_pages(tables: CaseTables, as_of=None) -> DataFrame:
    """Only the length of a text goes into the join, not the text."""
    lengths = tables["documento_conteudo"].select(
        "id_documento", F.octet_length("conteudo").cast("bigint").alias("bytes")
    )
    by_unit = (
        tables["documento"]
        .filter(F.col("sta_documento") == fixed.INTERNAL_DOCUMENT)
        .join(lengths, "id_documento")
        .groupBy(F.col("id_unidade_responsavel").alias("id_unidade"))
        .agg(F.sum("bytes").alias("bytes"))
    )
    return _pages(with_unit(by_unit, tables, "id_unidade"), fixed.KB_PER_INTERNAL_PAGE)


def _pages(by_unit: DataFrame, kb_per_page: float) -> DataFrame:
    """Bytes are summed as integers and divided once per unit."""
    return (
        by_unit.groupBy("orgao", "unidade")
        .agg(F.sum("bytes").alias("bytes"))
        .select(
            "orgao",
            "unidade",
            (F.col("bytes") / fixed.BYTES_PER_KB / kb_per_page).alias("folhas"),
        )
    )


# Derived marts


def stock_units(marts: Mapping[str, DataFrame]) -> DataFrame:
    return marts["stock_daily"].select("orgao", "unidade").distinct()


def open_process_summary(marts: Mapping[str, DataFrame]) -> DataFrame:
    return marts["open_process_control"].select(
        "num_processo",
        "data",
        "tipo_processo",
        "nivel_acesso",
        "unidade_atual",
        "dias_unidade",
        "atribuido",
        "data_filtro",
        "orgao_atual",
    )


def current_unit_options(marts: Mapping[str, DataFrame]) -> DataFrame:
    return (
        marts["days_in_unit_totals"]
        .select(F.col("orgao").alias("orgao_atual"), "unidade_atual")
        .distinct()
    )


def assignee_days(marts: Mapping[str, DataFrame]) -> DataFrame:
    return marts["open_process_control"].select(
        F.col("orgao_atual").alias("orgao"),
        "unidade_atual",
        "tipo_processo",
        "atribuido",
        "dias_unidade",
    )


def pages_saved(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Units with both kinds of documents."""
    internal = marts["internal_pages"].withColumnRenamed("folhas", "folhas_internas")
    return (
        marts["external_pages"]
        .join(internal, ["orgao", "unidade"])
        .select(
            "orgao", "unidade", (F.col("folhas") + F.col("folhas_internas")).alias("soma")
        )
    )


def lifetime_counts(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Processes by lifetime in days: all that medians, quartiles and boxes need."""
    return (
        marts["process_lifetime"]
        .groupBy("orgao", "unidade", "tipo_processo", "tempo_vida")
        .agg(rows().alias("processos"))
    )


def open_activity_rollup(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Open activities by days in the unit, with the assignee and without, in one pass.

    Most questions don't ask for the assignee, and without it there are far fewer rows.
    """
    place = ["orgao", "unidade_atual", "tipo_processo"]
    with_assignee = [*place, "atribuido", "dias_unidade"]
    columns = [F.col(c) for c in with_assignee]
    sets = [columns, [F.col(c) for c in with_assignee if c != "atribuido"]]
    return (
        marts["assignee_days"]
        .groupingSets(sets, *columns)
        .agg(F.grouping("atribuido").cast("int").alias("nivel"), rows().alias("atividades"))
        .select("nivel", *with_assignee, "atividades")
    )


def days_in_unit_counts(marts: Mapping[str, DataFrame]) -> DataFrame:
    return marts["open_activity_rollup"].filter("nivel = 0").drop("nivel")


def days_in_unit_totals(marts: Mapping[str, DataFrame]) -> DataFrame:
    return marts["open_activity_rollup"].filter("nivel = 1").drop("nivel", "atribuido")


def open_process_bitmaps(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Which processes are open where, as sets that can be united without counting twice.

    Processes are numbered without gaps, and a number is a bit of its bucket. Those of one
    place (the first of each process) stand together, so that a place needs few buckets. A
    large place is numbered in parts, chosen by a hash, so that no task numbers it alone.
    """
    place = ["orgao_atual", "unidade_atual", "tipo_processo"]
    held = (
        marts["open_process_control"]
        .filter(F.col("num_processo").isNotNull())
        .select(*place, "num_processo")
        .distinct()
    )
    first = held.groupBy("num_processo").agg(F.min(F.struct(*place)).alias("casa"))
    sizes = first.groupBy(F.col("casa").alias("_casa")).agg(rows().alias("processos"))
    cuts = sizes.withColumn("partes", F.expr(f"processos div {fixed.NUMBERED_TOGETHER} + 1"))
    numbered = first.join(cuts, F.col("casa").eqNullSafe(F.col("_casa"))).select(
        "num_processo",
        "casa",
        F.pmod(F.xxhash64("num_processo"), F.col("partes")).alias("parte"),
    )
    group = Window.partitionBy("casa", "parte").orderBy("num_processo")
    numbered = numbered.withColumn("n", F.row_number().over(group) - 1)
    # One row per place and part: parts hold some 20,000 processes.
    groups = numbered.groupBy(F.struct("casa", "parte").alias("_grupo")).agg(rows().alias("processos"))
    before = Window.orderBy("_grupo").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("inicio", F.coalesce(F.sum("processos").over(before), F.lit(0)))
    number = F.col("inicio") + F.col("n")
    bits = numbered.join(
        starts, F.struct("casa", "parte").eqNullSafe(F.col("_grupo"))
    ).select(
        "num_processo",
        F.bitmap_bucket_number(number + 1).alias("balde"),
        F.bitmap_bit_position(number + 1).alias("bit"),
    )
    return (
        held.join(bits, "num_processo")
        .groupBy(*place, "balde")
        .agg(F.bitmap_construct_agg("bit").alias("mapa"))
    )


def stock_daily(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Movements by day without the process: what flow and balance read."""
    return (
        marts["stock_movements"]
        .groupBy("orgao", "unidade", "tipo_processo", "atividade", "data")
        .agg(F.sum("qtde").alias("qtde"))
    )


def lifetime_median_by_type(marts: Mapping[str, DataFrame]) -> DataFrame:
    return (
        marts["lifetime_counts"]
        .groupBy("tipo_processo", "tempo_vida")
        .agg(F.sum("processos").alias("processos"))
        .groupBy("tipo_processo")
        .agg(median_of("tempo_vida", "processos").alias("mediana"))
    )


def days_in_unit_median_by_type(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Over all open activities, assigned or not."""
    return (
        marts["days_in_unit_totals"]
        .groupBy("tipo_processo", "dias_unidade")
        .agg(F.sum("atividades").alias("atividades"))
        .groupBy("tipo_processo")
        .agg(median_of("dias_unidade", "atividades").alias("mediana"))
    )


def lifetime_first_quartile(marts: Mapping[str, DataFrame]) -> DataFrame:
    """The lower bound of "expected", over all lifetimes. One row."""
    return (
        marts["lifetime_counts"]
        .groupBy("tempo_vida")
        .agg(F.sum("processos").alias("processos"))
        .agg(quantile_of("tempo_vida", 0.25, "processos").alias("q1"))
    )


BASE: dict[str, Callable] = {
    f.__name__: f
    for f in (
        active_orgs,
        processes_by_org_unit,
        active_users_by_org,
        distinct_process_types,
        process_types_by_org_unit,
        weekly_filings,
        weekly_history,
        monthly_filings,
        stock_movements,
        open_process_control,
        process_lifetime,
        external_pages,
        internal_pages,
    )
}

# Columns or rows of another mart under a name of their own, never stored a second time: the
# mart they come from, and how.
PROJECTIONS: dict[str, tuple[str, Callable]] = {
    "open_process_summary": ("open_process_control", open_process_summary),
    "assignee_days": ("open_process_control", assignee_days),
    "days_in_unit_counts": ("open_activity_rollup", days_in_unit_counts),
    "days_in_unit_totals": ("open_activity_rollup", days_in_unit_totals),
}

# Step by step: each step reads base marts, earlier steps and what is projected from them.
STEPS: list[list[Callable]] = [
    [lifetime_counts, open_activity_rollup, stock_daily, pages_saved, open_process_bitmaps],
    [
        stock_units,
        current_unit_options,
        lifetime_median_by_type,
        days_in_unit_median_by_type,
        lifetime_first_quartile,
    ],
]
DERIVED: dict[str, Callable] = {
    **{name: project for name, (_, project) in PROJECTIONS.items()},
    **{f.__name__: f for step in STEPS for f in step},
}


# Roll-ups that one question reads several times.
SHARED = {"lifetime_counts", "open_activity_rollup", "stock_daily", "open_process_bitmaps"}


class LazyMarts(Mapping):
    """All marts by name, each planned when first asked for. `SHARED` ones are then
    written to the shared folder, so that no question builds one twice."""

    def __init__(self, tables: CaseTables, as_of):
        self.tables = tables
        self.as_of = as_of
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in BASE:
                mart = BASE[name](self.tables, self.as_of)
            else:
                mart = DERIVED[name](self)
            self._built[name] = self.tables.stage(mart, name) if name in SHARED else mart
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(MARTS)

    def __len__(self) -> int:
        return len(MARTS)

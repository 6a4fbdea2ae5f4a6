"""Registered queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries
from casestats.fixed_values import ALL_ORGS, ALL_TYPES, ALL_UNITS
from casestats.functions import dates
from casestats.functions.digest import table_digest
from casestats.functions.stats import median_of
from casestats.functions.text import number_text
from casestats.operators import filters
from casestats.operators.lookups import with_unit
from casestats.operators.paging import next_cursor, numbered, table_page, table_page_after
from casestats.plans import access, analysis, evolution, indicators, stock
from casestats.plans.marts import LazyMarts
from casestats.session import configure
from casestats.sinks.csv import MOVEMENTS, export_csv, read_export
from casestats.sinks.marts import build_marts, read_marts
from casestats.sources import fixtures, landing
from casestats.sources.schemas import MARTS
from casestats.sources.staging import shared_dir
from casestats.sources.tables import load_access_tables, load_tables

try:
    import casestats.llm.queries as llm_queries
    import corpus_pipeline
except ImportError as missing:
    # The subpackage may be left out, and a library it needs may be absent: the other queries
    # must run without it.
    if missing.name not in ("casestats.llm", "casestats.llm.queries", "corpus_pipeline"):
        print(f"queries on training text are left out: {missing}", file=sys.stderr)
    llm_queries = corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = fixtures.AS_OF
# Its numbers of buckets depend on a hash: its sets are compared instead of its rows.
BITMAPS = "open_process_bitmaps"
PERIOD = {"start": "2000-01-01", "end": "2000-03-31"}
RANGE = {"start": "1998-02-10", "end": "1999-01-05"}
ORG, UNIT, TYPE = "AFRICA", "NATION_5", "2-HIGH"

SCOPES = {
    "all": (ALL_ORGS, ALL_UNITS),
    "org": (ORG, ALL_UNITS),
    "unit": (ALL_ORGS, UNIT),
    "org_unit": (ORG, UNIT),
}
STOCK_SCOPES = {
    "all": (ALL_ORGS, ALL_UNITS, ALL_TYPES, False),
    "org": (ORG, ALL_UNITS, ALL_TYPES, False),
    "unit": (ALL_ORGS, UNIT, ALL_TYPES, False),
    "type": (ALL_ORGS, ALL_UNITS, TYPE, False),
    "org_unit": (ORG, UNIT, ALL_TYPES, False),
    "org_type": (ORG, ALL_UNITS, TYPE, False),
    "unit_type": (ALL_ORGS, UNIT, TYPE, False),
    "org_unit_type": (ORG, UNIT, TYPE, False),
    "subunits": (ALL_ORGS, "NATION_1", ALL_TYPES, True),
    "org_subunits": ("AMERICA", "NATION_1", ALL_TYPES, True),
    "subunits_type": (ALL_ORGS, "NATION_1", TYPE, True),
    "org_subunits_type": ("AMERICA", "NATION_1", TYPE, True),
}

_marts: dict[tuple[str, str], LazyMarts] = {}


def marts_of(spark: SparkSession, sf_dir: str) -> LazyMarts:
    """Marts over the mapped tables, planned once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _marts:
        configure(spark)
        _marts[key] = LazyMarts(fixtures.case_tables(spark, sf_dir), AS_OF)
    return _marts[key]


def entry(spark: SparkSession) -> DataFrame:
    """The running stock balance."""
    marts = marts_of(spark, "/root/testdata/sf0.001")
    return stock.stock_balance(marts, **PERIOD)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def add(name, build):
        """Register a query that reads the marts."""
        q[name] = lambda spark, sf_dir: build(marts_of(spark, sf_dir))

    for name in MARTS:
        if name != BITMAPS:
            add(name, lambda m, name=name: m[name])
    add("open_process_sets", _set_sizes)

    q["load_tables"] = _loaded_tables
    q["land_tables"] = _landed_tables
    q["land_access_tables"] = _landed_access_tables
    q["load_access_tables"] = _loaded_access_tables
    q["write_marts"] = _written_marts
    q["export_csv"] = _exported
    q["export_csv_stock"] = _exported_stock
    q["export_csv_pages"] = _exported_pages
    q["export_csv_blanks"] = _exported_blanks

    movements = lambda build: lambda m: build(m["stock_movements"])
    add("scope_org_unit", lambda m: filters.scope(m["process_lifetime"], ORG, UNIT))
    add("scope_org_unit_type", movements(lambda df: filters.scope(df, ORG, UNIT, TYPE)))
    add("unit_exact", movements(lambda df: df.filter(filters.unit_exact("unidade", UNIT))))
    add(
        "unit_with_subunits",
        movements(lambda df: df.filter(filters.unit_with_subunits("unidade", "NATION_1"))),
    )
    add(
        "unit_with_subunits_literal",
        movements(
            lambda df: df.filter(filters.unit_with_subunits("unidade", "TION_2", literal=True))
        ),
    )
    add(
        "between_dates",
        movements(lambda df: df.filter(filters.between_dates("data", **PERIOD))),
    )
    add(
        "before_date",
        movements(lambda df: df.filter(filters.before_date("data", PERIOD["start"]))),
    )
    add("assigned_only", lambda m: m["assignee_days"].filter(filters.assigned_only()))
    add(
        "drop_wildcard_unit", lambda m: filters.drop_wildcard_unit(m["stock_units"], "unidade")
    )

    for key, selection in SCOPES.items():
        for plan in (
            indicators.open_process_count,
            indicators.registered_users,
            indicators.median_lifetime,
            indicators.top_process_types,
            indicators.pages_saved_total,
            indicators.weekly_evolution,
            indicators.lifetime_by_type,
            indicators.assignee_time,
            analysis.lifetime_distribution,
            analysis.lifetime_boxes,
        ):
            add(f"{plan.__name__}_{key}", lambda m, p=plan, s=selection: p(m, *s))
    for key, orgao in (("all", ALL_ORGS), ("org", ORG)):
        for plan in (indicators.unit_options, stock.stock_unit_options):
            add(f"{plan.__name__}_{key}", lambda m, p=plan, o=orgao: p(m, o))
    add("type_options", stock.type_options)
    add(
        "default_period",
        lambda m: stock.default_period(
            m.tables["protocolo"].agg(F.max("dta_geracao").alias("as_of"))
        ),
    )

    for key, (*selection, subunits) in STOCK_SCOPES.items():
        for plan in (
            stock.stock_flow,
            stock.stock_balance,
            stock.stock_chart,
            stock.stock_export,
        ):
            run = partial(plan, subunits=subunits, **PERIOD)
            add(f"{plan.__name__}_{key}", lambda m, r=run, s=selection: r(m, *s))
        for plan in (
            stock.open_process_table,
            stock.open_process_export,
            stock.stock_distinct_total,
        ):
            run = partial(plan, subunits=subunits)
            add(f"{plan.__name__}_{key}", lambda m, r=run, s=selection: r(m, *s))
    add(
        "stock_balance_by_unit",
        lambda m: stock.stock_balance(m, by=["orgao", "unidade"], **PERIOD),
    )
    add(
        "table_page",
        lambda m: table_page(
            stock.open_process_table(m),
            search="5-low",
            sort=[("dias_unidade", False)],
            page=3,
        ),
    )

    add("table_page_after", _third_page)
    add("lifetime_by_type_headers", lambda m: indicators.lifetime_by_type(m, ORG, headers=True))
    add("assignee_time_headers", lambda m: indicators.assignee_time(m, ORG, headers=True))
    for key, build in {
        "top_process_types": lambda m: indicators.top_process_types(m, ORG),
        "lifetime_by_type": lambda m: indicators.lifetime_by_type(m, ORG),
        "assignee_time": indicators.assignee_time,
        "weekly_evolution": lambda m: indicators.weekly_evolution(m, ORG),
        "unit_options": indicators.unit_options,
        "stock_balance": lambda m: stock.stock_balance(m, **PERIOD),
        "project_monthly": lambda m: evolution.project_monthly(m, start="1996-01-01"),
    }.items():
        add(f"order_{key}", lambda m, build=build: numbered(build(m)))

    for key, token in oracle_queries.TOKENS.items():
        q[f"authorized_orgs_{key}"] = partial(_authorized, token=token)
        q[f"restrict_to_orgs_{key}"] = partial(_restricted, token=token)

    add("project_weekly", evolution.project_weekly)
    add("project_monthly", lambda m: evolution.project_monthly(m, start="1996-01-01"))
    add("project_weekly_range", lambda m: evolution.project_weekly(m, **RANGE))
    add("project_monthly_range", lambda m: evolution.project_monthly(m, **RANGE))
    for plan in (evolution.migration_ranking_weekly, evolution.migration_ranking_monthly):
        add(plan.__name__, lambda m, p=plan: p(m, fixtures.paper_filings(m.tables), AS_OF))

    add("date_functions", _date_functions)
    add("number_text", _number_text)
    if llm_queries:
        q |= llm_queries.QUERIES
        q["pipeline"] = corpus_pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    sql = oracle_queries.build()
    return sql | llm_queries.ORACLE_SQL if llm_queries else sql


def _authorized(spark, sf_dir, token):
    active = marts_of(spark, sf_dir)["active_orgs"]
    return access.authorized_orgs(fixtures.access_tables(spark, sf_dir), active, token, AS_OF)


def _restricted(spark, sf_dir, token):
    types = marts_of(spark, sf_dir)["process_types_by_org_unit"]
    return access.restrict_to_orgs(types, _authorized(spark, sf_dir, token))


def _new_folder(spark, name):
    return f"{shared_dir(spark)}/casestats/{name}-{uuid.uuid4().hex}"


def _digests(frames):
    """What each frame holds, see `table_digest`."""
    told = [table_digest(df).select(F.lit(name).alias("nome"), "*") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, told)


def _laid_out(spark, frames, name):
    """Mapped tables as source files."""
    folder = _new_folder(spark, name)
    for table, df in frames.items():
        df.write.parquet(f"{folder}/{table}.parquet")
    return folder


def _loaded_tables(spark, sf_dir):
    tables = marts_of(spark, sf_dir).tables
    return _digests(load_tables(spark, _laid_out(spark, tables, "source")))


def _loaded_access_tables(spark, sf_dir):
    configure(spark)
    tables = fixtures.access_tables(spark, sf_dir)
    return _digests(load_access_tables(spark, _laid_out(spark, tables, "access")))


def _landed_tables(spark, sf_dir):
    """The manifest of a landing of the case-file tables."""
    source = _laid_out(spark, marts_of(spark, sf_dir).tables, "source")
    return _landing(spark, landing.land, source)


def _landed_access_tables(spark, sf_dir):
    configure(spark)
    source = _laid_out(spark, fixtures.access_tables(spark, sf_dir), "access")
    return _landing(spark, landing.land_access, source)


def _landing(spark, land, source):
    path = _new_folder(spark, "landed")
    told = landing.manifest(spark, path, land(spark, source, path))
    return told.drop("pouso", "lido_de", "lido_ate").withColumnRenamed("tabela", "nome")


def _written_marts(spark, sf_dir):
    configure(spark)
    folder = _new_folder(spark, "marts")
    build_marts(fixtures.case_tables(spark, sf_dir), folder, AS_OF)
    marts = read_marts(spark, folder)
    return _digests({name: df for name, df in marts.items() if name != BITMAPS})


def _set_sizes(marts):
    """How many processes each place's sets hold."""
    return (
        marts[BITMAPS]
        .groupBy("orgao_atual", "unidade_atual", "tipo_processo")
        .agg(F.sum(F.bitmap_count("mapa")).alias("processos"))
    )


def _third_page(marts):
    """Page by page, each after the last row of the one before."""
    table = stock.open_process_table(marts)
    search, sort, cursor = "5-low", [("dias_unidade", False)], None
    for _ in range(2):
        shown = table_page_after(table, cursor, search=search, sort=sort).collect()
        cursor = next_cursor(shown, cursor)
    return table_page_after(table, cursor, search=search, sort=sort)


def _exported(spark, sf_dir):
    rows = stock.open_process_export(marts_of(spark, sf_dir))
    return read_export(spark, export_csv(rows, _new_folder(spark, "export")))


def _exported_stock(spark, sf_dir):
    rows = stock.stock_export(marts_of(spark, sf_dir), **PERIOD)
    return read_export(spark, export_csv(rows, _new_folder(spark, "export"), name=MOVEMENTS))


def _exported_pages(spark, sf_dir):
    rows = marts_of(spark, sf_dir)["pages_saved"]
    return read_export(spark, export_csv(rows, _new_folder(spark, "export"), name="folhas"))


def _exported_blanks(spark, sf_dir):
    """Blanks at both ends, and a text that is a blank alone."""
    rows = marts_of(spark, sf_dir)["stock_units"].select(
        "orgao", F.concat(F.lit("  "), "unidade", F.lit(" ")).alias("unidade"), F.lit(" ").alias("so")
    )
    return read_export(spark, export_csv(rows, _new_folder(spark, "export"), "A/B"))


def _date_functions(marts):
    dia = F.col("dia")
    inicio = dates.week_start(dia)
    return (
        marts.tables["protocolo"]
        .select(F.to_date("dta_geracao").alias("dia"))
        .distinct()
        .select(
            "dia",
            inicio.alias("inicio"),
            dates.week_of_year(dia).alias("semana"),
            dates.sunday_number(inicio).alias("domingo"),
            dates.week_label(inicio, F.date_add(inicio, 6)).alias("intervalo"),
            dates.month_start(dia).alias("mes"),
            dates.previous_month_end(dia).alias("fim_mes_anterior"),
            dates.short_date(dia).alias("curta"),
            dates.period_label(dia).alias("periodo"),
        )
    )


def _number_text(marts):
    sizes = (
        marts.tables["anexo"]
        .groupBy("id_unidade", "tamanho")
        .agg(F.count(F.lit(1)).alias("anexos"))
    )
    return (
        with_unit(sizes, marts.tables, "id_unidade")
        .groupBy("unidade")
        .agg(
            number_text(F.sum(F.col("tamanho") * F.col("anexos"))).alias("total"),
            number_text(median_of("tamanho", "anexos")).alias("mediana"),
        )
    )

"""Timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The mapped source tables are laid out first (not timed). Timed are the daily mart job,
each mart on its own straight from the source tables, and the parameterised queries over
the written marts, as a user of the marts would run them. Every query is collected whole
by the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from functools import partial
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from casestats.plans import access, analysis, evolution, indicators, stock
from casestats.plans.marts import BASE, LazyMarts
from casestats.session import SETTINGS
from casestats.sinks.csv import export_csv
from casestats.sinks.marts import build_marts, read_marts
from casestats.sources import fixtures
from casestats.sources.staging import shared_dir
from casestats.sources.tables import load_access_tables, load_tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
AS_OF = fixtures.AS_OF
PERIOD = {"start": "2000-01-01", "end": "2000-03-31"}


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def over_marts(marts, tables, access_tables):
    org, unit, kind = "AFRICA", "NATION_5", "2-HIGH"
    paper = fixtures.paper_filings(tables)
    token = partial(access.authorized_orgs, access_tables, marts["active_orgs"])
    return {
        "open_process_count": lambda: indicators.open_process_count(marts, org),
        "registered_users": lambda: indicators.registered_users(marts, org),
        "median_lifetime": lambda: indicators.median_lifetime(marts, org),
        "top_process_types": lambda: indicators.top_process_types(marts, org),
        "pages_saved_total": lambda: indicators.pages_saved_total(marts, org),
        "weekly_evolution": lambda: indicators.weekly_evolution(marts, org),
        "unit_options": lambda: indicators.unit_options(marts, org),
        "lifetime_by_type": lambda: indicators.lifetime_by_type(marts, org, unit),
        "assignee_time": lambda: indicators.assignee_time(marts, org),
        "stock_unit_options": lambda: stock.stock_unit_options(marts, org),
        "type_options": lambda: stock.type_options(marts),
        "stock_flow": lambda: stock.stock_flow(marts, org, **PERIOD),
        "stock_balance": lambda: stock.stock_balance(marts, **PERIOD),
        "stock_balance_subunits": lambda: stock.stock_balance(
            marts, "Todos", "NATION_1", kind, subunits=True, **PERIOD
        ),
        "stock_balance_by_unit": lambda: stock.stock_balance(
            marts, by=["orgao", "unidade"], **PERIOD
        ),
        "stock_chart": lambda: stock.stock_chart(marts, org, **PERIOD),
        "open_process_table": lambda: stock.open_process_table(marts, org, unit, kind),
        "open_process_export": lambda: stock.open_process_export(marts, org),
        "stock_distinct_total": lambda: stock.stock_distinct_total(marts, org),
        "stock_export": lambda: stock.stock_export(marts, **PERIOD),
        "lifetime_distribution": lambda: analysis.lifetime_distribution(marts, org),
        "lifetime_boxes": lambda: analysis.lifetime_boxes(marts, org),
        "authorized_orgs": lambda: token("tok_100", AS_OF),
        "project_weekly": lambda: evolution.project_weekly(marts),
        "project_monthly": lambda: evolution.project_monthly(marts, start="1996-01-01"),
        "migration_ranking_weekly": lambda: evolution.migration_ranking_weekly(
            marts, paper, AS_OF
        ),
    }


def main() -> None:
    spark = session()
    timings: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - start, 3)

    def drain(plan):
        plan().write.format("noop").mode("overwrite").save()

    root = f"{shared_dir(spark)}/casestats/bench-{uuid.uuid4().hex}"
    mapped = {
        **fixtures.case_tables(spark, SF_DIR),
        **fixtures.access_tables(spark, SF_DIR),
    }
    for name, df in mapped.items():
        df.write.parquet(f"{root}/source/{name}.parquet")
    source = f"{root}/source"

    timed("build_marts", lambda: build_marts(load_tables(spark, source), f"{root}/m", AS_OF))
    for name in BASE:
        marts = LazyMarts(load_tables(spark, source), AS_OF)
        timed(f"mart_{name}", lambda m=marts, n=name: drain(lambda: m[n]))

    marts = read_marts(spark, f"{root}/m")
    plans = over_marts(marts, load_tables(spark, source), load_access_tables(spark, source))
    for name, plan in plans.items():
        timed(name, partial(drain, plan))
    timed(
        "export_csv",
        lambda: export_csv(stock.open_process_export(marts, "AFRICA"), root, "AFRICA"),
    )
    print(
        json.dumps(
            {
                "metric": "mart job, single marts and queries over written marts, total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

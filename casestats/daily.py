"""The daily job: `spark-submit casestats/daily.py --source DIR --marts DIR`.

A database is landed before marts are built. `as_of` is the wall clock of the administration,
as its times are.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from casestats.session import configure
from casestats.sinks.marts import build_marts, expire
from casestats.sources import landing
from casestats.sources.tables import load_tables


def wall_clock_of(given: str | None, zone: str, now: dt.datetime | None = None) -> str:
    """`given`, or now, as the wall clock in `zone`. A time with an offset is moved there."""
    moment = dt.datetime.fromisoformat(given) if given else now or dt.datetime.now(dt.UTC)
    if moment.tzinfo:
        moment = moment.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return moment.isoformat(sep=" ", timespec="seconds")


def main(argv: Sequence[str] | None = None) -> None:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--source", help="folder with the source tables as Parquet")
    options.add_argument("--jdbc", help="JSON file with JDBC options, instead of --source")
    options.add_argument("--marts", required=True, help="folder the marts are written to")
    options.add_argument("--landing", help="folder for the landed tables; beside the marts, if left out")
    options.add_argument("--land", action="store_true", help="land a --source folder too")
    options.add_argument("--as-of", help="the time results refer to; now, if left out")
    options.add_argument("--zone", default="UTC", help="zone of the administration's clock")
    options.add_argument("--instants", action="store_true", help="stored times are instants, not wall clock")
    options.add_argument("--keep", type=int, help="published runs and landings to keep; all, if left out")
    given = options.parse_args(argv)
    if bool(given.source) == bool(given.jdbc):
        options.error("give either --source or --jdbc")
    source = given.source
    if given.jdbc:
        with open(given.jdbc, encoding="utf-8") as file:
            source = json.load(file)

    spark = configure(SparkSession.builder.appName("casestats").getOrCreate())
    as_of = wall_clock_of(given.as_of, given.zone)
    zone = given.zone if given.instants else None
    landed = given.landing or f"{given.marts}/landed"
    if given.jdbc or given.land:
        run = landing.land(spark, source, landed, zone)
        tables = landing.load_landed(spark, landed, run)
    else:
        tables = load_tables(spark, source, zone)
    build_marts(tables, given.marts, as_of)
    if given.keep:
        expire(spark, given.marts, given.keep)
        landing.expire(spark, landed, given.keep)


if __name__ == "__main__":
    main()

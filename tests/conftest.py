import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from casestats.session import SETTINGS
from casestats.sources.schemas import ACCESS_TABLES, CASE_TABLES, MARTS
from casestats.sources.tables import CaseTables


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(ddl, rows)"""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)


@pytest.fixture
def case_tables(frame):
    """case_tables(protocolo=[...], ...): tables that are left out are empty."""

    def make(**rows):
        return CaseTables({n: frame(ddl, rows.get(n, [])) for n, ddl in CASE_TABLES.items()})

    return make


@pytest.fixture
def access_tables(frame):
    def make(**rows):
        return {n: frame(ddl, rows.get(n, [])) for n, ddl in ACCESS_TABLES.items()}

    return make


@pytest.fixture
def marts(frame):
    """marts(stock_daily=[...], ...): just the marts given."""
    return lambda **rows: {n: frame(MARTS[n], r) for n, r in rows.items()}


@pytest.fixture
def setting(spark):
    """setting(key, value) for the length of a test."""
    before = {}

    def change(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def rows(df):
    return [tuple(r) for r in df.collect()]


def at(text):
    """`2001-02-03` or `2001-02-03 04:05`"""
    return datetime.fromisoformat(text)

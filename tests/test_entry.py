"""Registered queries against DuckDB on the driver's smallest tables."""

from datetime import date, datetime
from pathlib import Path

import pytest

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()
# Queries of the subpackage that may be left out have their own tests.
OWN = set(registered.llm_queries.QUERIES) | {"pipeline"} if registered.llm_queries else set()
RUN = [name for name in QUERIES if name not in OWN]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def comparable(table, columns):
    def plain(v):
        if isinstance(v, datetime):
            return v.isoformat()
        return v.isoformat() if isinstance(v, date) else v

    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) - OWN == set(ORACLE) - OWN


@pytest.mark.parametrize("name", RUN)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert comparable(got, df.columns) == comparable(expected, columns)


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["data", "estoque_diario", "estoque"]
    assert df.count() > 0

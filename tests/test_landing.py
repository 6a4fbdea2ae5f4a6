"""Landing, clocks, splits, digests and what a run leaves behind."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import at, rows
from pyspark.sql import functions as F
from test_marts import activity, process

from casestats import daily
from casestats.functions.digest import table_digest
from casestats.sinks.marts import build_marts, expire, read_marts
from casestats.sources import landing, staging
from casestats.sources.schemas import ACCESS_TABLES, CASE_TABLES, SPLIT_KEYS
from casestats.sources.staging import Staging, abandoned, folders, shared_dir
from casestats.sources.tables import (
    bounds_query, jdbc_options, load_tables, planned_split, read_table, wall_clock,
)

AS_OF = "2001-08-01 12:00:00"


def some_tables(case_tables, sigla="A", kind="compra"):
    return case_tables(
        orgao=[(1, sigla, "S")], unidade=[(10, 1, "U")], usuario=[(1, 1, "ana", "S")],
        tipo_procedimento=[(1, kind)], procedimento=[(1, 1)],
        protocolo=[process(1, "2001-07-01")], atividade=[activity(1, 1, "2001-07-01")],
    )


def written(tables, folder):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def source(case_tables, tmp_path):
    return written(some_tables(case_tables), tmp_path / "source")


def test_marts_read_the_landed_copy_only(spark, case_tables, source, tmp_path, monkeypatch):
    read = []
    real = landing.read_table
    monkeypatch.setattr(landing, "read_table", lambda *a: read.append(a[2]) or real(*a))
    run = landing.land(spark, source, f"{tmp_path}/landed")
    assert sorted(read) == sorted(CASE_TABLES)  # each table once

    tables = landing.load_landed(spark, f"{tmp_path}/landed", run)
    for df in tables.values():
        assert all(f"/landed/{run}/" in f for f in df.inputFiles())
    # The database goes on changing.
    written(some_tables(case_tables, "B", "obra"), source)
    marts = build_marts(tables, f"{tmp_path}/marts", AS_OF)
    assert rows(marts["active_orgs"]) == [("A",)]
    assert rows(marts["open_process_control"].select("orgao", "tipo_processo")) == [("A", "compra")]
    assert sorted(read) == sorted(CASE_TABLES)


def test_what_refers_is_read_before_what_it_refers_to(spark, source, tmp_path):
    run = landing.land(spark, source, str(tmp_path / "l"))
    told = landing.manifest(spark, str(tmp_path / "l"), run).collect()
    begun, ended = ({r.tabela: r[c] for r in told} for c in ("lido_de", "lido_ate"))
    for later, earlier in (
        ("protocolo", "atividade"), ("protocolo", "procedimento"), ("protocolo", "documento"),
        ("documento", "documento_conteudo"), ("unidade", "protocolo"), ("orgao", "unidade"),
        ("usuario", "atividade"), ("tipo_procedimento", "procedimento"), ("unidade", "anexo"),
    ):
        assert ended[earlier] <= begun[later]
    assert {(r.tabela, r.coluna) for r in told if r.coluna != "*"} == {
        (t, c.split()[0]) for t, ddl in CASE_TABLES.items() for c in ddl.split(", ")
    }


def test_a_landing_goes_on_where_it_was_cut_off(spark, source, tmp_path, monkeypatch):
    path, read = str(tmp_path / "landed"), []
    real = landing.read_table

    def lost(*a):
        if a[2] == "protocolo" and "protocolo" not in read:
            read.append("protocolo")
            raise RuntimeError("connection lost")
        read.append(a[2])
        return real(*a)

    monkeypatch.setattr(landing, "read_table", lost)
    with pytest.raises(RuntimeError):
        landing.land(spark, source, path, run="night")
    with pytest.raises(ValueError, match="protocolo"):
        landing.load_landed(spark, path, "night")
    with pytest.raises(ValueError, match="no complete"):
        landing.load_landed(spark, path)
    read[:] = ["protocolo"]
    landing.land(spark, source, path, run="night")
    assert sorted(read[1:]) == ["orgao", "protocolo", "tipo_procedimento", "unidade", "usuario"]
    assert landing.load_landed(spark, path)["orgao"].count() == 1
    # Landing what is complete reads nothing.
    read[:] = ["protocolo"]
    landing.land(spark, source, path, run="night")
    assert read == ["protocolo"]


def test_changed_files_differ_from_the_manifest(spark, source, tmp_path, frame):
    path = str(tmp_path / "landed")
    run = landing.land(spark, source, path)
    assert rows(landing.differences(spark, path, run)) == []
    other = frame(CASE_TABLES["unidade"], [(10, 2, "U")])
    other.write.mode("overwrite").parquet(f"{path}/{run}/unidade.parquet")
    assert sorted(rows(landing.differences(spark, path, run))) == [
        ("unidade", "*"), ("unidade", "id_orgao"),
    ]


def test_old_landings_go(spark, source, tmp_path):
    path = str(tmp_path / "landed")
    for run in ("c", "a", "b"):
        landing.land(spark, source, path, run=run)
    landing.land(spark, source, path, run="part", schemas={"orgao": CASE_TABLES["orgao"]})
    assert landing.expire(spark, path, keep=4) == []
    assert landing.expire(spark, path, keep=2) == ["c"]
    assert folders(spark, path) == ["a", "b", "part"]
    assert landing._latest(spark, path, CASE_TABLES) == "b"


def test_access_tables_are_landed_too(spark, access_tables, tmp_path):
    source = written(access_tables(acesso_orgao=[(1, "A"), (99, "*")]), tmp_path / "access")
    path = str(tmp_path / "landed")
    landing.land_access(spark, source, path)
    landed = landing.load_landed_access(spark, path)
    assert set(landed) == set(ACCESS_TABLES)
    assert sorted(rows(landed["acesso_orgao"])) == [(1, "A"), (99, "*")]


def test_the_daily_job_lands(spark, source, tmp_path):
    arguments = ["--source", source, "--marts", f"{tmp_path}/m", "--land", "--keep", "1"]
    for day in ("01", "02"):
        daily.main([*arguments, "--as-of", f"2001-08-{day} 12:00:00"])
    assert len(folders(spark, f"{tmp_path}/m/landed")) == 1
    assert len(folders(spark, f"{tmp_path}/m/runs")) == 1
    assert rows(read_marts(spark, f"{tmp_path}/m")["active_orgs"]) == [("A",)]


# Clocks


def test_wall_clock_of():
    now = dt.datetime(2001, 8, 1, 1, 30, tzinfo=dt.UTC)
    assert daily.wall_clock_of(None, "America/Sao_Paulo", now) == "2001-07-31 22:30:00"
    assert daily.wall_clock_of(None, "UTC", now) == "2001-08-01 01:30:00"
    assert daily.wall_clock_of("2001-08-01 12:00:00", "America/Sao_Paulo") == AS_OF
    assert daily.wall_clock_of("2001-08-01T12:00:00+02:00", "UTC") == "2001-08-01 10:00:00"


def test_instants_are_moved_to_the_zone(frame):
    ddl = "t TIMESTAMP, x INT"
    df = frame(ddl, [(at("2001-08-01 01:30"), 1), (None, 2)])
    moved = wall_clock(df, ddl, "America/Sao_Paulo").select(F.col("t").cast("string"))
    assert rows(moved) == [("2001-07-31 22:30:00",), (None,)]
    stay = wall_clock(df, ddl, None).select(F.col("t").cast("string"))
    assert rows(stay) == [("2001-08-01 01:30:00",), (None,)]


def test_times_without_a_zone_stay(spark, frame, tmp_path):
    ddl = CASE_TABLES["atividade"]
    df = frame(ddl, [(1, 2, 3, 1, at("2001-08-01 23:30"), None, None)])
    df.withColumn("dth_abertura", F.col("dth_abertura").cast("timestamp_ntz")).write.parquet(
        f"{tmp_path}/atividade.parquet"
    )
    got = read_table(spark, str(tmp_path), "atividade", ddl, "America/Sao_Paulo")
    assert rows(got.select(F.col("dth_abertura").cast("string"))) == [("2001-08-01 23:30:00",)]
    assert dict(got.dtypes)["dth_abertura"] == "timestamp"


ZONES = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from casestats.session import configure
from casestats.plans.marts import LazyMarts
from casestats.sources.tables import load_tables
spark = configure(
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.extraJavaOptions", "-Duser.timezone=" + sys.argv[3]).getOrCreate()
)
assert spark._jvm.java.util.TimeZone.getDefault().getID() == sys.argv[3]
marts = LazyMarts(load_tables(spark, sys.argv[2]), "2001-08-01 12:00:00")
days = marts["stock_movements"].select(F.col("data").cast("string")).collect()
held = marts["open_process_control"].select("data", "dias_unidade", "tempo_vida").collect()
print("DAYS", sorted(map(tuple, days)), sorted(map(tuple, held)))
"""


def test_days_are_the_same_in_two_jvm_zones(spark, case_tables, tmp_path):
    """Late and early hours, stored without a zone."""
    tables = some_tables(case_tables)
    late = [activity(1, 1, "2001-07-01 23:30"), activity(2, 1, "2001-07-02 00:30")]
    tables["atividade"] = case_tables(atividade=late)["atividade"]
    tables["protocolo"] = case_tables(protocolo=[process(1, "2001-06-30 23:59")])["protocolo"]
    for name in ("atividade", "protocolo"):
        df = tables[name]
        times = [c for c, t in df.dtypes if t == "timestamp"]
        tables[name] = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})
    source = written(tables, tmp_path / "source")
    script = tmp_path / "zones.py"
    script.write_text(ZONES)
    repo = str(Path(__file__).resolve().parents[1])
    told = []
    for zone in ("America/Sao_Paulo", "Asia/Tokyo"):
        out = subprocess.run(
            [sys.executable, str(script), repo, source, zone],
            capture_output=True, text=True, timeout=180, check=True,
        ).stdout
        told += [line for line in out.splitlines() if line.startswith("DAYS")]
    assert told[0] == told[1]
    assert "2001-07-01" in told[0] and "2001-07-02" in told[0] and "30/6/2001" in told[0]


# JDBC: options only, no database is started here.


def test_bounds_are_planned_from_the_table():
    asked = []

    def ask(query):
        asked.append(query)
        return (1, 10_000_000, 4_500_000)

    source = {"options": {"url": "jdbc:x:y"}}
    options = jdbc_options(source, "atividade", CASE_TABLES["atividade"], ask)
    assert asked == [bounds_query("atividade", "id_atividade")]
    assert asked == ["SELECT MIN(id_atividade), MAX(id_atividade), COUNT(*) FROM atividade"]
    assert (options["partitionColumn"], options["numPartitions"]) == ("id_atividade", "5")
    assert (options["lowerBound"], options["upperBound"]) == ("1", "10000001")
    assert "TIMESTAMP_NTZ" in options["customSchema"] and options["preferTimestampNTZ"] == "true"
    # Small tables are read by one task, whatever their name.
    assert "partitionColumn" not in jdbc_options(source, "orgao", CASE_TABLES["orgao"], ask)


def test_an_own_split_column_and_table():
    source = {
        "options": {"url": "u"}, "splits": {"anexo": "id_anexo"},
        "tables": {"anexo": "(SELECT * FROM anexo WHERE sin_ativo = 'S') t"},
    }
    asked = []
    jdbc_options(source, "anexo", CASE_TABLES["anexo"], lambda q: asked.append(q) or (None, None, 0))
    assert asked == [
        "SELECT MIN(id_anexo), MAX(id_anexo), COUNT(*) "
        "FROM (SELECT * FROM anexo WHERE sin_ativo = 'S') t"
    ]


def test_growing_tables_are_not_read_by_one_task():
    source = {"options": {"url": "u"}, "splits": {"atividade": None}}
    ddl = CASE_TABLES["atividade"]
    assert "partitionColumn" not in jdbc_options(source, "atividade", ddl, lambda _: (10,))
    with pytest.raises(ValueError, match="5000000 rows"):
        jdbc_options(source, "atividade", ddl, lambda _: (5_000_000,))
    with pytest.raises(ValueError, match="not known"):
        jdbc_options({"options": {}}, "atividade", ddl)
    assert set(SPLIT_KEYS) < set(CASE_TABLES)


def test_planned_split():
    assert planned_split("k", (None, None, 0)) is None
    assert planned_split("k", (5, 90, 1_000_000)) is None
    assert planned_split("k", (5, 90, 3_000_001)) == ("k", 5, 91, 4)
    # No more tasks than keys.
    assert planned_split("k", (1, 2, 50_000_000)) == ("k", 1, 3, 2)
    assert planned_split("k", (7, 7, 50_000_000)) is None


# Digests


def test_digest_sees_moved_values(frame):
    ddl = "a STRING, b STRING, n BIGINT, x DOUBLE, d DATE, t TIMESTAMP"
    day, time = dt.date(2001, 2, 3), at("2001-02-03 04:05")
    given = [("p", "q", 1, 0.5, day, time), ("r", "s", None, None, None, None), (None, "", 2, 1.5, day, time)]

    def digest(values):
        return {r.coluna: tuple(r) for r in table_digest(frame(ddl, values)).collect()}

    plain = digest(given)
    assert plain == digest(given[::-1])
    assert plain["n"][:5] == ("n", 3, 2, "1", "2") and plain["*"][:3] == ("*", 3, 3)
    assert plain["b"][3:5] == ("", "s")
    swapped = digest([(b, a, *rest) for a, b, *rest in given])
    assert {c for c in plain if plain[c] != swapped[c]} == {"a", "b", "*"}
    # A value that moves to another row changes whole rows alone.
    other = digest([("r", "q", 1, 0.5, day, time), ("p", "s", None, None, None, None), given[2]])
    assert {c for c in plain if plain[c] != other[c]} == {"*"}
    # NULL and the empty text differ; so does a repeated row.
    assert plain["a"] != digest([*given[:2], ("", "", 2, 1.5, day, time)])["a"]
    assert plain != digest([*given, given[0]])
    assert {r[5] for r in digest([]).values()} == {"0"}


def test_swapped_columns_turn_the_registered_queries_red(spark, monkeypatch):
    registered = pytest.importorskip("__spark_entry__")
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def compared(name):
        df = registered.queries()[name](spark, sf_dir)
        result = con.execute(registered.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        return set(rows(df.select(*columns))) ^ set(result.fetchall())

    assert compared("load_access_tables") == set()
    real = registered.load_access_tables

    def wrong(*a):
        tables = real(*a)
        p = tables["permissao"]
        tables["permissao"] = p.select(F.col("id_orgao").alias("id_user"), F.col("id_user").alias("id_orgao"))
        return tables

    monkeypatch.setattr(registered, "load_access_tables", wrong)
    assert {(r[0], r[1]) for r in compared("load_access_tables")} == {
        ("permissao", "id_user"), ("permissao", "id_orgao"), ("permissao", "*"),
    }


# What a run leaves


def test_the_staged_tables_of_a_job_go_with_it(spark, case_tables, tmp_path, monkeypatch):
    kept = []
    real = Staging.stage
    monkeypatch.setattr(
        Staging, "stage", lambda self, df, name: kept.append((name, self.folder)) or real(self, df, name)
    )
    tables = some_tables(case_tables)
    marts = build_marts(tables, str(tmp_path / "m"), AS_OF)
    assert [name for name, _ in kept] == ["processes"]
    assert not Path(kept[0][1].removeprefix("file:")).exists()
    assert marts["process_lifetime"].count() == 1
    # The tables can be used again: what was derived from them is derived anew.
    again = build_marts(tables, str(tmp_path / "m"), AS_OF)
    assert again["process_lifetime"].count() == 1


def test_a_job_that_fails_leaves_nothing_staged(spark, case_tables, tmp_path, monkeypatch):
    import casestats.sinks.marts as store

    before = folders(spark, f"{shared_dir(spark)}/casestats/runs")

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_write", lost)
    with pytest.raises(RuntimeError):
        build_marts(some_tables(case_tables), str(tmp_path / "m"), AS_OF)
    assert folders(spark, f"{shared_dir(spark)}/casestats/runs") == before


def test_abandoned_runs_are_found_by_their_manifest(spark, frame):
    run = Staging(spark)
    run.stage(frame("id BIGINT", [(1,)]), "ids")
    assert [r.name for r in run.manifest().collect()] == ["ids"]
    assert run.folder not in abandoned(spark, older_than_hours=1)
    assert run.folder in abandoned(spark, older_than_hours=-1)
    assert folders(spark, run.folder) == []
    assert abandoned(spark, older_than_hours=-1) == []


def test_shared_folders(monkeypatch):
    staging.require_shared("hdfs://n/x", "yarn", "file:///")
    staging.require_shared("/x", "yarn", "hdfs://n")
    with pytest.raises(ValueError, match="share"):
        staging.require_shared("/x", "yarn", "file:///")


ODD_ORGS = ["", None, "A/B", "007", "n", "v", "__HIVE_DEFAULT_PARTITION__", "a=b c%d"]


def test_orgs_of_any_name_come_back(spark, case_tables, tmp_path):
    n = len(ODD_ORGS)
    tables = case_tables(
        orgao=[(k, org, "S") for k, org in enumerate(ODD_ORGS)],
        unidade=[(k, k, f"U{k}") for k in range(n)], usuario=[(1, 1, "ana", "S")],
        tipo_procedimento=[(1, "compra")], procedimento=[(k, 1) for k in range(n)],
        protocolo=[process(k, "2001-07-01", unit=k) for k in range(n)],
        atividade=[activity(k, k, "2001-07-01", unit=k) for k in range(n)],
    )
    path = str(tmp_path / "m")
    marts = build_marts(tables, path, AS_OF)
    for name, org in (
        ("stock_movements", "orgao"), ("open_process_control", "orgao_atual"),
        ("process_lifetime", "orgao"), ("stock_daily", "orgao"), ("days_in_unit_totals", "orgao"),
        ("open_process_bitmaps", "orgao_atual"),
    ):
        found = marts[name]
        assert sorted(r[0] or str(r[0]) for r in found.select(org).collect()) == sorted(
            o or str(o) for o in ODD_ORGS
        )
        for k, value in enumerate(ODD_ORGS):
            same = found.filter(F.col(org).eqNullSafe(F.lit(value)))
            assert same.count() == 1, (name, k)
    # Other tools find the org in the files.
    plain = spark.read.option("recursiveFileLookup", "true").parquet(
        marts["stock_movements"].inputFiles()[0].rsplit("/pasta=", 1)[0]
    )
    assert {r.orgao for r in plain.collect()} == set(ODD_ORGS)


def test_old_runs_go(spark, case_tables, tmp_path):
    path = str(tmp_path)
    for day in ("01", "02", "03"):
        build_marts(some_tables(case_tables, day), path, f"2001-08-{day} 00:00:00")
    assert expire(spark, path, keep=4) == []
    gone = expire(spark, path, keep=2)
    assert [g[:10] for g in gone] == ["2001-08-01"] and len(folders(spark, f"{path}/runs")) == 2
    assert rows(read_marts(spark, path)["active_orgs"]) == [("03",)]


def test_loading_without_landing(spark, source):
    assert rows(load_tables(spark, source)["orgao"]) == [(1, "A", "S")]

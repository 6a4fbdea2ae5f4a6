import os
import subprocess
import sys
import time
from datetime import date
from pathlib import Path

import pytest
from conftest import rows

from casestats import daily
from casestats.plans.marts import LazyMarts
from casestats.sinks.csv import export_csv, read_export
from casestats.sinks.marts import build_marts, read_marts, run_name, write_marts
from casestats.sources.schemas import CASE_TABLES, MARTS
from casestats.sources import staging
from casestats.sources.staging import executors_share, release, require_shared, shared_dir, stage
from casestats.sources.tables import jdbc_options


def test_export_csv(spark, frame, tmp_path):
    df = frame(
        "`Número` STRING, `Órgão` STRING, dias BIGINT, folhas DOUBLE, dia DATE",
        [
            ("P1", 'a;b "c"\nd', 3, 12345678.25, date(2001, 2, 3)),
            ("P2", None, None, 2.0, None),
        ],
    )
    target = export_csv(df, str(tmp_path), "AFRICA")
    assert target.endswith("/controle_processos_AFRICA.csv")
    files = list((tmp_path / "controle_processos_AFRICA.csv").glob("part-*"))
    text = "".join(sorted((f.read_bytes().decode("utf-16-le") for f in files), reverse=True))
    assert text.startswith("Número;Órgão;dias;folhas;dia\n")
    assert '"a;b ""c""\nd";3;12345678,25;2001-02-03' in text
    assert sorted(rows(read_export(spark, target))) == [
        ("P1", 'a;b "c"\nd', "3", "12345678,25", "2001-02-03"),
        ("P2", None, None, "2", None),
    ]


def lazy(case_tables, as_of, sigla):
    tables = case_tables(orgao=[(1, sigla, "S")], usuario=[(1, 1, "ana", "S")])
    return LazyMarts(tables, as_of)


def test_latest_run_is_read(spark, case_tables, tmp_path):
    path = str(tmp_path)
    for as_of, sigla in (("2001-08-02 12:00:00", "B"), ("2001-08-01 12:00:00", "A")):
        write_marts(lazy(case_tables, as_of, sigla), path, as_of)
    latest = read_marts(spark, path)
    assert set(latest) == set(MARTS)
    assert rows(latest["active_users_by_org"]) == [("B", 1)]
    assert rows(read_marts(spark, path, "2001-08-01 12:00:00")["active_orgs"]) == [("A",)]


def test_a_run_can_be_repeated(spark, case_tables, tmp_path):
    path = str(tmp_path)
    first = build_marts(lazy(case_tables, "2001-08-01", "A").tables, path, "2001-08-01")
    build_marts(lazy(case_tables, "2001-08-01", "B").tables, path, "2001-08-01")
    assert rows(read_marts(spark, path)["active_orgs"]) == [("B",)]
    assert rows(first["active_orgs"]) == [("A",)]
    with pytest.raises(ValueError):
        read_marts(spark, path, "2001-08-02")


def test_an_unfinished_run_is_not_read(spark, case_tables, tmp_path):
    path = str(tmp_path)
    write_marts(lazy(case_tables, "2001-08-01", "A"), path, "2001-08-01")

    class Broken(LazyMarts):
        def __getitem__(self, name):
            if name == "internal_pages":
                raise RuntimeError("lost")
            return super().__getitem__(name)

    with pytest.raises(RuntimeError):
        tables = lazy(case_tables, "2001-08-02", "B").tables
        write_marts(Broken(tables, "2001-08-02"), path, "2001-08-02")
    assert rows(read_marts(spark, path)["active_orgs"]) == [("A",)]


def test_short_names_that_look_like_numbers_stay_text(spark, case_tables, tmp_path):
    from test_marts import activity, process

    tables = case_tables(
        orgao=[(1, "007", "S")], unidade=[(10, 1, "1e3")], usuario=[(1, 1, "ana", "S")],
        tipo_procedimento=[(1, "compra")], procedimento=[(1, 1)],
        protocolo=[process(1, "2001-07-01")], atividade=[activity(1, 1, "2001-07-01")],
    )
    written = build_marts(tables, str(tmp_path), "2001-08-01")
    assert rows(written["stock_movements"].select("orgao", "unidade")) == [("007", "1e3")]
    assert rows(written["open_process_summary"].select("orgao_atual")) == [("007",)]


def test_run_name():
    assert run_name("2001-08-01 12:00:00") == "2001-08-01T12-00-00"
    assert run_name("2001-08-01T12:00:00") == "2001-08-01T12-00-00"
    assert run_name(date(2001, 8, 1)) == "2001-08-01T00-00-00"


def test_stage_uses_the_shared_folder(spark, frame):
    df = stage(frame("id BIGINT", [(1,), (2,)]), "ids")
    assert sorted(rows(df)) == [(1,), (2,)]
    assert shared_dir(spark) in df.inputFiles()[0]


def test_jdbc_options():
    source = {
        "options": {"url": "jdbc:x:y", "fetchsize": 10_000},
        "tables": {"acesso_orgao": "orgao"},
        "splits": {"protocolo": ("id_protocolo", 0, 10**9, 200)},
    }
    ddl = CASE_TABLES["protocolo"]
    assert jdbc_options(source, "protocolo", ddl) == {
        "url": "jdbc:x:y", "fetchsize": "10000", "dbtable": "protocolo",
        "customSchema": ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ"), "preferTimestampNTZ": "true",
        "partitionColumn": "id_protocolo", "lowerBound": "0", "upperBound": "1000000000",
        "numPartitions": "200",
    }
    assert jdbc_options(source, "acesso_orgao", "x INT")["dbtable"] == "orgao"
    assert "partitionColumn" not in jdbc_options(source, "orgao", "x INT")


def test_daily_job(spark, case_tables, tmp_path):
    tables = case_tables(orgao=[(1, "A", "S")], usuario=[(1, 1, "ana", "S")])
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/source/{name}.parquet")
    arguments = ["--source", f"{tmp_path}/source", "--marts", f"{tmp_path}/marts"]
    daily.main([*arguments, "--as-of", "2001-08-01 12:00:00"])
    assert rows(read_marts(spark, f"{tmp_path}/marts")["active_users_by_org"]) == [("A", 1)]
    with pytest.raises(SystemExit):
        daily.main(["--marts", "m"])


def test_export_keeps_blanks_and_digits(spark, frame, tmp_path):
    texts = [("  lead", 1e-17), ("trail  ", 5e-324), (" ", 123456789.125), ("x", 0.1)]
    target = export_csv(frame("t string, x double", texts), str(tmp_path), "A/B", name="n")
    assert target.endswith("/n_A%2FB.csv")
    found = dict(rows(read_export(spark, target)))
    assert found["  lead"] == "0,00000000000000001" and found["x"] == "0,1"
    assert found[" "] == "123456789,125" and found["trail  "].startswith("0,000")


def test_staging_refuses_a_local_folder_on_a_cluster():
    require_shared("file:/tmp/x", "local[2]")
    require_shared("hdfs:/x", "yarn")
    with pytest.raises(ValueError, match="share"):
        require_shared("file:///tmp/x", "yarn")


@pytest.fixture
def on_a_cluster(spark, setting, monkeypatch):
    """on_a_cluster(folder): the session takes itself for one on a cluster that names it."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://head:7077")
    monkeypatch.setattr(staging, "CHECKPOINT_DIR", "test.checkpoint.dir")
    monkeypatch.setattr(staging, "_found_dirs", {})
    return lambda folder: setting("test.checkpoint.dir", folder)


def test_staging_in_a_mounted_folder_of_a_cluster(spark, on_a_cluster, tmp_path):
    on_a_cluster(tmp_path.as_uri())
    kept = stage(spark.range(3).toDF("id"), "ids")
    assert kept.count() == 3 and shared_dir(spark) == tmp_path.as_uri()
    assert [f.name[:4] for f in (tmp_path / "casestats").iterdir()] == ["ids-"]  # the trial is gone


def test_staging_elsewhere_where_a_cluster_shares_no_named_folder(spark, on_a_cluster, monkeypatch):
    assert not executors_share(spark, "file:/proc/none")
    monkeypatch.setattr(staging, "executors_share", lambda _, folder: "staging" in folder)
    on_a_cluster("file:/proc/none")
    with pytest.warns(UserWarning, match="file:/proc/none"):
        found = shared_dir(spark)
    assert found == f"{spark.conf.get('spark.sql.warehouse.dir')}/casestats-staging"
    monkeypatch.setattr(staging, "executors_share", lambda *_: False)
    on_a_cluster("/proc/other")
    with pytest.raises(ValueError, match="/proc/other"):
        shared_dir(spark)


WITHOUT_SETTING = """
from pyspark.sql import SparkSession
from casestats.sources.staging import CHECKPOINT_DIR, shared_dir, stage
build = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = build.config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get(CHECKPOINT_DIR, None) is None
kept = stage(spark.range(3).toDF("id"), "ids")
assert kept.count() == 3 and shared_dir(spark) in kept.inputFiles()[0]
assert shared_dir(spark) == shared_dir(spark.newSession())
assert shared_dir(spark).startswith("file:///")
spark.sparkContext.setCheckpointDir("NAMED")
assert shared_dir(spark).startswith("file:NAMED/")
assert stage(spark.range(2).toDF("id"), "ids").count() == 2
print("staged")
"""


def test_staging_without_the_setting(tmp_path):
    """A session of its own, as defaults may name the folder for this one."""
    for name in ("defaults", "temp", "named"):
        (tmp_path / name).mkdir()
    script = WITHOUT_SETTING.replace("NAMED", str(tmp_path / "named"))
    environment = os.environ | {
        "SPARK_CONF_DIR": str(tmp_path / "defaults"),
        "TMPDIR": str(tmp_path / "temp"),
        "PYTHONPATH": str(Path(__file__).resolve().parents[1]),
    }
    # The tests' own gateway is not to be shared.
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        environment.pop(name, None)
    run = subprocess.run(
        [sys.executable, "-c", script], env=environment, cwd=tmp_path, capture_output=True,
        text=True, timeout=120,
    )
    assert run.stdout.endswith("staged\n"), run.stderr[-2000:]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_release_frees_the_shuffle_of_a_written_table(spark, tmp_path):
    release(spark)
    before = shuffle_files(spark)
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "written"))
    assert shuffle_files(spark) - before
    release(spark)
    until = time.monotonic() + 5
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.05)
    assert not left

"""What the plans look like, and that hot keys are split."""

import contextlib
import io
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from casestats.operators.lookups import activity_summary, followed_processes, small_side
from casestats.plans import access, indicators, stock
from casestats.plans.marts import LazyMarts
from casestats.sinks.marts import build_marts
from casestats.sources.schemas import CASE_TABLES, MARTS, schema_of
from casestats.sources.tables import load_tables

AS_OF = "2001-08-01 12:00:00"
PERIOD = {"start": "2001-01-10", "end": "2001-02-10"}
PROCESSES, ACTIVITIES = 3_000, 240_000


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def scan_of(text, table):
    """The block of a formatted plan that describes the scan of a source table."""
    blocks = re.findall(r"\(\d+\) Scan parquet.*?\n\n", text, re.S)
    return next(b for b in blocks if f"/{table}.parquet" in b)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Source files in which process 0, user 0 and unit 0 hold a third of all rows."""
    folder = tmp_path_factory.mktemp("source")

    def hot(modulus, salt):
        mixed = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(modulus))
        return F.when(F.pmod(F.xxhash64("id", F.lit(salt + 1)), F.lit(3)) == 0, 0).otherwise(mixed)

    day = F.lit("2001-01-01").cast("timestamp")
    opened = day + F.make_dt_interval(days=F.pmod(F.col("id"), F.lit(60)).cast("int"))
    frames = {
        "orgao": spark.range(3).selectExpr("id AS id_orgao", "concat('O', id) AS sigla", "'S' AS sin_ativo"),
        "unidade": spark.range(9).selectExpr("id AS id_unidade", "id % 3 AS id_orgao", "concat('U', id) AS sigla"),
        "usuario": spark.range(500).selectExpr("id AS id_usuario", "id % 3 AS id_orgao", "concat('n', id) AS nome", "'S' AS sin_ativo"),
        "protocolo": spark.range(PROCESSES).select(
            F.col("id").alias("id_protocolo"), F.col("id").cast("string").alias("protocolo_formatado"),
            F.lit("P").alias("sta_protocolo"), day.alias("dta_geracao"), hot(9, 1).alias("id_unidade_geradora"),
            hot(500, 3).alias("id_usuario_gerador"), F.lit(0).alias("sta_nivel_acesso_global"),
            F.lit("d").alias("descricao")),
        "procedimento": spark.range(PROCESSES).selectExpr("id AS id_procedimento", "id % 5 AS id_tipo_procedimento"),
        "tipo_procedimento": spark.range(5).selectExpr("id AS id_tipo_procedimento", "concat('t', id) AS nome"),
        "atividade": spark.range(ACTIVITIES, numPartitions=8).select(
            F.col("id").alias("id_atividade"), hot(PROCESSES, 5).alias("id_protocolo"), hot(9, 7).alias("id_unidade"),
            F.lit(1).alias("id_tarefa"), opened.alias("dth_abertura"),
            F.when(F.pmod(F.col("id"), F.lit(2)) == 0, opened).alias("dth_conclusao"),
            hot(500, 9).alias("id_usuario_atribuicao")),
        "anexo": spark.range(100).selectExpr("id % 9 AS id_unidade", "id AS tamanho"),
        "documento": spark.range(100).selectExpr("id AS id_documento", "id % 9 AS id_unidade_responsavel", "'I' AS sta_documento"),
        "documento_conteudo": spark.range(100).selectExpr("id AS id_documento", "repeat('é', int(id)) AS conteudo"),
    }
    for name, df in frames.items():
        typed = df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(CASE_TABLES[name])])
        typed.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def skewed(spark, source, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    setting("spark.sql.shuffle.partitions", "8")
    return LazyMarts(load_tables(spark, source), AS_OF)


def test_a_hot_process_is_split_in_stock_movements(skewed):
    df = skewed["stock_movements"]
    got = df.collect()
    assert "SortMergeJoin(skew=true)" in plan(df)
    assert sum(r.qtde for r in got) == ACTIVITIES
    assert len({(r.protocolo, r.unidade, r.data) for r in got}) == len(got)


def test_a_hot_process_and_a_hot_user_are_split_in_the_control_mart(skewed):
    df = skewed["open_process_control"]
    assert len(df.collect()) == ACTIVITIES // 2
    # By process, and by assignee.
    assert plan(df).count("SortMergeJoin(skew=true)") >= 2


def test_a_hot_process_is_combined_before_the_shuffle(skewed):
    text = plan(activity_summary(skewed.tables))
    assert text.rindex("partial_max_by") > text.index("Exchange")
    assert skewed["process_lifetime"].count() == PROCESSES


def test_the_mart_job_with_hot_keys(spark, skewed, tmp_path):
    written = build_marts(skewed.tables, str(tmp_path), AS_OF)
    total = written["stock_daily"].agg(F.sum("qtde")).first()[0]
    assert total == ACTIVITIES
    assert rows(indicators.open_process_count(written)) == [(ACTIVITIES // 2,)]
    # The org that holds most rows is cut into several files.
    hot_org = [f for f in written["stock_movements"].inputFiles() if "pasta=vO0" in f]
    assert len(hot_org) > 1


@pytest.fixture
def plain(spark, source):
    return LazyMarts(load_tables(spark, source), AS_OF)


@pytest.mark.parametrize("name", list(MARTS))
def test_no_mart_multiplies_rows_or_leaves_the_jvm(plain, name):
    text = plan(plain[name])
    for operator in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval"):
        assert operator not in text
    assert [(f.name, f.dataType) for f in plain[name].schema] == [
        (f.name, f.dataType) for f in schema_of(MARTS[name])
    ]


@pytest.mark.parametrize(
    "query",
    [
        lambda m: indicators.lifetime_by_type(m, "O1"),
        lambda m: indicators.assignee_time(m, "O1"),
        lambda m: indicators.top_process_types(m),
        lambda m: stock.stock_chart(m, "O1", **PERIOD),
    ],
)
def test_queries_do_not_multiply_rows(plain, query):
    text = plan(query(plain))
    for operator in ("CartesianProduct", "NestedLoop", "Python", "ArrowEval"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(plain):
    scan = scan_of(plan(plain["weekly_filings"], "formatted"), "protocolo")
    assert "EqualTo(sta_protocolo,P)" in scan
    assert "LessThan(dta_geracao,2001-07-29" in scan
    assert "GreaterThanOrEqual(dta_geracao,2001-05-20" in scan
    assert "descricao" not in scan

    moves = scan_of(plan(plain["stock_movements"], "formatted"), "atividade")
    assert "In(id_tarefa, [1,28,29,32,41])" in moves
    assert "id_usuario_atribuicao" not in moves


def test_texts_are_measured_before_the_shuffle(skewed):
    text = plan(skewed["internal_pages"])
    exchange = text.rindex("Exchange hashpartitioning(id_documento")
    assert text.index("octet_length(conteudo") > exchange
    assert "conteudo" not in text[:exchange]


def test_the_balance_window_runs_over_sums_by_day(marts, frame):
    m = {"stock_daily": frame(MARTS["stock_daily"], [])}
    text = plan(stock.stock_balance(m, **PERIOD))
    assert text.index("Window") < text.index("SinglePartition") < text.index("HashAggregate")
    by_unit = plan(stock.stock_balance(m, by=["orgao", "unidade"], **PERIOD))
    assert "SinglePartition" not in by_unit


def test_a_lookup_beyond_the_bound_is_not_broadcast(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    left, right = spark.range(10), spark.range(10)
    assert "BroadcastHashJoin" in plan(left.join(small_side(right, 10), "id"))
    assert "SortMergeJoin" in plan(left.join(small_side(right, 9), "id"))


def test_written_marts_are_pruned_by_org(spark, plain, tmp_path):
    written = build_marts(plain.tables, str(tmp_path), AS_OF)
    text = plan(stock.stock_export(written, "O1", **PERIOD))
    assert "pasta" in text.split("PartitionFilters: [")[1].split("DataFilters")[0]
    assert "GreaterThanOrEqual(data,2001-01-10)" in text


def test_moves_of_closed_processes_are_dropped_before_the_shuffle(skewed, setting):
    setting("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    text = plan(skewed["stock_movements"])
    assert "might_contain" in text
    # Below the exchange of the moves: lower lines are earlier steps.
    assert text.index("might_contain") > text.index("Exchange hashpartitioning(id_protocolo")


def test_texts_stay_out_of_the_process_table(skewed):
    staged = followed_processes(skewed.tables)
    assert not {"descricao", "protocolo_formatado"} & set(staged.columns)
    for name in ("stock_movements", "process_lifetime"):
        assert "descricao" not in plan(skewed[name])


def test_restricted_marts_are_pruned_by_org(spark, plain, frame, tmp_path):
    written = build_marts(plain.tables, str(tmp_path), AS_OF)
    one = frame("orgao STRING", [("O1",)])
    df = access.restrict_to_orgs(written["stock_movements"], one)
    filters = plan(df).split("PartitionFilters: [")[1].split("DataFilters")[0]
    assert "subquery" in filters.lower() and "pasta" in filters
    assert {r.orgao for r in df.select("orgao").distinct().collect()} == {"O1"}

"""The case-file tables, mapped from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casestats.fixed_values import PROCESS, WILDCARD
from casestats.functions.dates import moment
from casestats.sources.schemas import ACCESS_TABLES, CASE_TABLES, schema_of
from casestats.sources.tables import CaseTables

AS_OF = "2001-08-01 12:00:00"
WILDCARD_ID = 99


def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    region, nation, customer = read("region"), read("nation"), read("customer")
    orders, documents = read("orders"), read("documents")

    frames = {
        "orgao": region.select(
            F.col("r_regionkey").alias("id_orgao"),
            F.col("r_name").alias("sigla"),
            F.when(F.col("r_regionkey") == 4, "N").otherwise("S").alias("sin_ativo"),
        ),
        "unidade": nation.select(
            F.col("n_nationkey").alias("id_unidade"),
            F.col("n_regionkey").alias("id_orgao"),
            F.col("n_name").alias("sigla"),
        ),
        "usuario": customer.join(
            nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").alias("id_usuario"),
            F.col("n_regionkey").alias("id_orgao"),
            F.col("c_name").alias("nome"),
            F.when(F.col("c_acctbal") > 0, "S").otherwise("N").alias("sin_ativo"),
        ),
        "protocolo": orders.join(
            customer.select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        ).select(
            F.col("o_orderkey").alias("id_protocolo"),
            F.col("o_orderkey").cast("string").alias("protocolo_formatado"),
            F.col("o_orderstatus").alias("sta_protocolo"),
            F.col("o_orderdate").cast("timestamp").alias("dta_geracao"),
            F.col("c_nationkey").alias("id_unidade_geradora"),
            F.col("o_custkey").alias("id_usuario_gerador"),
            (F.col("o_orderkey") % 4).alias("sta_nivel_acesso_global"),
            F.col("o_orderpriority").alias("descricao"),
        ),
        "procedimento": orders.select(
            F.col("o_orderkey").alias("id_procedimento"),
            _type_id().alias("id_tipo_procedimento"),
        ),
        "tipo_procedimento": orders.select(
            _type_id().alias("id_tipo_procedimento"),
            F.col("o_orderpriority").alias("nome"),
        ).distinct(),
        "atividade": _activities(read("lineitem"), orders, read("supplier")),
        "anexo": documents.select(
            (F.col("doc_id") % 25).alias("id_unidade"),
            F.col("n_chars").alias("tamanho"),
        ),
        "documento": documents.select(
            F.col("doc_id").alias("id_documento"),
            (F.col("doc_id") * 7 % 25).alias("id_unidade_responsavel"),
            F.when(F.col("doc_id") % 2 == 0, "I").otherwise("X").alias("sta_documento"),
        ),
        "documento_conteudo": documents.select(
            F.col("doc_id").alias("id_documento"), F.col("text").alias("conteudo")
        ),
    }
    return CaseTables({n: _typed(df, CASE_TABLES[n]) for n, df in frames.items()})


def access_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    user = F.col("c_custkey")
    wildcard = spark.range(1).select(
        F.lit(WILDCARD_ID).alias("id"), F.lit(WILDCARD).alias("sigla")
    )
    frames = {
        "auth": customer.select(
            F.concat(F.lit("tok_"), user.cast("string")).alias("token"),
            user.alias("id_user"),
            (moment(AS_OF) - F.make_dt_interval(hours=(user % 72).cast("int"))).alias(
                "created_at"
            ),
        ),
        "permissao": customer.select(
            user.alias("id_user"),
            F.when(user % 50 == 0, WILDCARD_ID).otherwise(user % 5).alias("id_orgao"),
        ),
        "acesso_orgao": region.select(
            F.col("r_regionkey").alias("id"), F.col("r_name").alias("sigla")
        ).union(wildcard),
    }
    return {n: _typed(df, ACCESS_TABLES[n]) for n, df in frames.items()}


def paper_filings(tables: CaseTables) -> DataFrame:
    """Stand-in for the paper counts: items that are not processes, by unit's org and day."""
    return (
        tables["protocolo"]
        .filter(F.col("sta_protocolo") != PROCESS)
        .groupBy("id_unidade_geradora", F.to_date("dta_geracao").alias("data"))
        .agg(F.count(F.lit(1)).alias("papel"))
        .join(
            tables["unidade"].select(
                F.col("id_unidade").alias("id_unidade_geradora"), "id_orgao"
            ),
            "id_unidade_geradora",
        )
        .join(tables["orgao"].select("id_orgao", F.col("sigla").alias("orgao")), "id_orgao")
        .groupBy("orgao", "data")
        .agg(F.sum("papel").alias("papel"))
    )


def _type_id() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("bigint")


def _activities(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Lines of an order become its activities.

    The id leaves room for 999 activities of one process, so the numbering window never
    holds more rows than that; frames that do not read the id plan no window at all.
    """
    numbering = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"
    )
    task = F.element_at(
        F.create_map(*[F.lit(v) for kv in TASK_BY_LINE.items() for v in kv]),
        F.col("l_linenumber"),
    )
    opened = F.least(
        F.col("o_orderdate").cast("timestamp")
        + F.make_dt_interval(
            days=((F.col("l_partkey") + 7 * F.col("l_linenumber")) % 30).cast("int")
        ),
        moment(AS_OF),
    )
    closed = F.when(
        F.col("l_linestatus") != "O",
        F.col("dth_abertura")
        + F.make_dt_interval(days=F.floor("l_quantity").cast("int")),
    )
    return (
        lineitem.withColumn("n", F.row_number().over(numbering))
        .join(
            orders.select("o_orderkey", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            supplier.select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .withColumn("dth_abertura", opened)
        .select(
            (F.col("l_orderkey") * 1000 + F.col("n")).alias("id_atividade"),
            F.col("l_orderkey").alias("id_protocolo"),
            F.col("s_nationkey").alias("id_unidade"),
            task.alias("id_tarefa"),
            "dth_abertura",
            closed.alias("dth_conclusao"),
            F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias(
                "id_usuario_atribuicao"
            ),
        )
    )


TASK_BY_LINE = {1: 1, 2: 28, 3: 29, 4: 41, 5: 32, 6: 28, 7: 99}


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(ddl)])

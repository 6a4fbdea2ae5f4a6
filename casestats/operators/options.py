"""Option lists of the selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepend_all(options: DataFrame, entry: str) -> DataFrame:
    """Sorted options under one column, with the "all" entry first."""
    spark = options.sparkSession
    head = spark.range(1).select(F.lit(entry).alias("opcao"), F.lit(0).alias("ordem"))
    rest = options.select(F.col(options.columns[0]).alias("opcao"), F.lit(1).alias("ordem"))
    return head.unionByName(rest).orderBy("ordem", "opcao").select("opcao")

"""CSV export: semicolons, decimal comma, UTF-16LE, one header per file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from casestats.fixed_values import ALL_ORGS
from casestats.functions.text import decimal_comma

FORMAT = {
    "sep": ";",
    "encoding": "UTF-16LE",
    "header": "true",
    "quote": '"',
    "escape": '"',
    # Blanks at the ends of a text are part of it.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
PROCESSES, MOVEMENTS = "controle_processos", "movimentos_estoque"


def file_name(name: str, orgao: str) -> str:
    """`<name>_<orgao>.csv`; what can't stand in a file name is written as %XX."""
    safe = re.sub(r'[%/\\:*?"<>|{}\[\]\x00-\x1f]', lambda m: f"%{ord(m[0]):02X}", orgao)
    return f"{name}_{safe}.csv"


def export_csv(df: DataFrame, path: str, orgao: str = ALL_ORGS, name: str = PROCESSES) -> str:
    """Write `<name>_<orgao>.csv` under `path`, a folder of part files, and return its path.
    Every task writes its own part. NULL is an empty field."""
    target = f"{path}/{file_name(name, orgao)}"
    fractional = (DoubleType, FloatType)
    columns = [
        decimal_comma(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, fractional)
        else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    df.select(*columns).write.mode("overwrite").options(**FORMAT).csv(target)
    return target


def read_export(spark: SparkSession, target: str) -> DataFrame:
    """An export as text columns."""
    return spark.read.options(**FORMAT).option("multiLine", "true").csv(target)

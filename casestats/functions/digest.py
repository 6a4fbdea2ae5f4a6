"""What a table holds, in a few rows that don't depend on the order of its own.

Any engine with MD5 can compute the same: it tells whether a copy is whole, whether values
moved to another column, and whether they moved to another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, DataType, DateType, DoubleType, FloatType, TimestampNTZType, TimestampType,
)

DIGEST = (
    "coluna STRING, linhas BIGINT, preenchidos BIGINT, minimo STRING, maximo STRING, soma STRING"
)

# The name under which whole rows are summed.
ROW = "*"
SEPARATOR = "\x1f"

# Fractions count to this many parts; least and greatest texts are shown up to so many characters.
PARTS, SHOWN = 1000, 64


def as_text(x: Column, kind: DataType) -> Column:
    """A value in the one form that is hashed."""
    if isinstance(kind, (DoubleType, FloatType)):
        x = x.cast("double")
        whole = F.floor(x * PARTS).cast("string")
        return F.when(F.abs(x) < 2**53, whole).otherwise(x.cast("string"))
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, BinaryType):
        return F.hex(x)
    return x.cast("string")


def hashed(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as a number whose sums have room."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def table_digest(df: DataFrame) -> DataFrame:
    """One row per column and one (`*`) for whole rows, see `DIGEST`; one pass over `df`.

    Columns are taken in the order of their names. An empty table has sums of 0.
    """
    fields = sorted(df.schema, key=lambda f: f.name)
    texts = df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    value = {f.name: F.col(f"`{f.name}`") for f in fields}
    whole = F.concat_ws(
        SEPARATOR,
        *[F.coalesce(F.concat(F.lit("v"), x), F.lit("n")) for x in value.values()],
    )
    none = F.lit(None).cast("string")

    def row(name, filled, least, greatest, number):
        total = F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string")
        return F.struct(
            F.lit(name).alias("coluna"), F.count(F.lit(1)).alias("linhas"),
            filled.alias("preenchidos"), least.alias("minimo"), greatest.alias("maximo"),
            total.alias("soma"),
        )

    rows = [
        row(n, F.count(x), F.left(F.min(x), F.lit(SHOWN)), F.left(F.max(x), F.lit(SHOWN)), hashed(x))
        for n, x in value.items()
    ]
    rows.append(row(ROW, F.count(F.lit(1)), none, none, hashed(whole)))
    return texts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

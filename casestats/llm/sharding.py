"""Sharding as vector bin packing.

Documents are weighed in three dimensions: bytes, tokens (words between white space) and
rows. What is placed is a unit, of which there are a bounded number whatever the input: a group
of equal texts that is heavier than one part in `shards * per_shard`, or many lighter groups
dealt together by hash. So equal texts stay together. Only a group of more than `WHOLE` of a
shard's bytes is cut, by id, as no shard could hold it among its share. Units (never the rows)
are placed one by one, heaviest first, into the shard whose residual capacity has the highest
dot product with the unit's weights. Bytes count most, so the law kept is `bytes`; a dimension
that is used up in a shard counts as no capacity there.

A heavy unit is numbered in pieces (bundles) that follow each other in its shard, so that no
task numbers a hot group alone.

A NULL text weighs its 16 bytes of overhead and has CRC 0. Rows with equal ids and texts get
slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestats.llm.common import if_small, keyed, stage

SHARDS = 40
OVERHEAD = 16
# Bundles by hash for each shard; a heavier group is a unit of its own.
BUNDLES_PER_SHARD = 128
# The share of a shard's bytes up to which a group stays whole.
WHOLE = 0.9
# Weight of bytes, tokens and rows in the dot product.
WEIGHTS = (64.0, 1.0, 1.0)


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return keyed(docs).select(
        "doc_id",
        "text_key",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group"),
    )


def bundled(rows: DataFrame, shards: int, per_shard: int) -> DataFrame:
    """`rows` with `bundle` (long), by hash of the group or a piece of a heavy one, and `unit`
    (long), the bundles that are placed together."""
    n = shards * per_shard
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    totals = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    share = F.greatest(
        F.col("bytes") / F.lit(totals.bytes or 1), F.col("rows") / F.lit(totals.rows or 1)
    )
    # Shares add up to 2 at most, so no more than 2 n groups can be heavy.
    heavy = (
        groups.withColumn("pieces", F.ceil(share * n))
        .filter(F.col("pieces") > 1)
        .withColumn("whole", F.col("bytes") * shards <= F.lit(WHOLE * (totals.bytes or 1)))
        .select(F.col("group").alias("_group"), "pieces", "whole")
    )
    heavy = if_small(stage(heavy, "heavy_groups"))
    by_hash = F.pmod(F.xxhash64("group"), F.lit(n))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    # Pieces and heavy groups have numbers beyond those of the bundles by hash.
    beyond = lambda *x: F.lit(n) + F.pmod(F.xxhash64(*x), F.lit(2**62 - n))
    own = beyond("group", piece)
    return (
        rows.join(heavy, rows["group"] == heavy["_group"], "left")
        .withColumn("bundle", F.when(F.col("pieces").isNull(), by_hash).otherwise(own))
        .withColumn("unit", F.when(F.col("whole"), beyond("group")).otherwise(F.col("bundle")))
    )


def place(bundles: pd.DataFrame, shards: int, weights=WEIGHTS) -> pd.DataFrame:
    """bundle, shard and the first slot of the bundle in its shard."""
    units, unit = np.unique(bundles["unit"].to_numpy("int64"), return_inverse=True)
    weighed = bundles[["bytes", "tokens", "rows"]].to_numpy(float)
    load = np.zeros((len(units), 3))
    np.add.at(load, unit, weighed)
    load = load / np.maximum(load.sum(axis=0), 1)
    order = np.lexsort((units, -load.max(axis=1)))
    residual = np.full((shards, 3), 1.0 / shards)
    to = np.zeros(len(units), "int32")
    for i in order:
        left = np.column_stack([residual[:, 0], np.maximum(residual[:, 1:], 0)])
        to[i] = int(np.argmax(left @ (load[i] * weights)))
        residual[to[i]] -= load[i]
    shard = to[unit]
    # Bundles of a shard one after another, those of a unit together.
    first = np.zeros(len(bundles), "int64")
    rows = bundles["rows"].to_numpy("int64")
    filled = np.zeros(shards, "int64")
    for k in np.lexsort((bundles["bundle"].to_numpy(), unit)):
        first[k] = filled[shard[k]]
        filled[shard[k]] += rows[k]
    return pd.DataFrame({"bundle": bundles["bundle"], "shard": shard, "first": first})


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, per_shard: int = BUNDLES_PER_SHARD
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, tokens of every row."""
    spark = docs.sparkSession
    rows = stage(bundled(measured(docs), shards, per_shard), "bundled")
    bundles = rows.groupBy("bundle", "unit").agg(
        F.sum("size").alias("bytes"),
        F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("rows"),
    )
    # At most n by hash and 4 n pieces or so: bounded by `shards * per_shard`, not by the input.
    placed = place(bundles.orderBy("bundle").toPandas(), shards)
    places = spark.createDataFrame(placed, "bundle long, shard int, first long")
    order = Window.partitionBy("bundle").orderBy("doc_id", "text_key")
    return (
        rows.withColumn("rank", F.row_number().over(order) - 1)
        .join(F.broadcast(places), "bundle")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first") + F.col("rank")).alias("slot"),
            "tokens",
        )
    )

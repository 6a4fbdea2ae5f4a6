"""From raw documents to encoded ones, in five stages.

Each stage works on all rows its predecessor kept, is written as Parquet and read again, and
all but the last return the columns of `documents`. ORACLE_SQL is None: nearest-neighbour
scores, linked components and BPE can't be expressed in SQL; tests compare each stage but the
first, whose score is tested by itself, with a brute-force version.

NULL and empty texts have the toxicity of the labelled texts without words; else they are neither
boilerplate, near copies nor contaminated, stay as they are and have no ids at the end. NULL ids are ids of their own; a near copy with a NULL id
goes before one with an id. Of repeated rows one stays. Other columns keep their values under any name
(but `n_chars`, where lines went) up to the last stage. Whole texts are read, however long. Without
labels nobody is toxic; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestats.llm import bpe, decontamination, line_dedup, ngram_join, toxicity
from casestats.llm.common import free_name, ready, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; `labels` teach the score."""
    ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave the texts; no document goes. `n_chars` is made
    to fit."""
    ready(spark)
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    cut = F.col(free_name(docs, "n_dropped")) > 0
    chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ready(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or more go."""
    ready(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (uint32, little-endian)."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(docs, path, with_ids=True).drop("text_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return docs

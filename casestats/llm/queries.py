"""The operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from casestats.llm import (
    bpe,
    decontamination,
    hard_negatives,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    sharding,
    spotsigs,
    suffix_dedup,
    token_output,
    toxicity,
    variants,
)
from casestats.llm.common import ready, table


def op1_suffix_dedup(spark, sf_dir):
    ready(spark)
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.drop("text_key", "kept")


def op2_benchmark_decontamination(spark, sf_dir):
    ready(spark)
    docs, items = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    return decontamination.decontaminate(docs, items).drop("text_key")


def op3_fingerprints(spark, sf_dir):
    ready(spark)
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    ready(spark)
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return toxicity.score_documents(docs, labels).drop("text_key")


def op5_line_dedup(spark, sf_dir):
    """A document's source is its host."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.drop_boilerplate(docs, F.col("source"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op6_ngram_jaccard_join(spark, sf_dir):
    ready(spark)
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_token_output(spark, sf_dir):
    """Where every piece of a text's BPE ids was written, and its sequence's check sum as read
    from the shards."""
    ready(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = token_output.materialise(table(spark, sf_dir, "documents"), vocabulary)
    sums = token_output.read_sequences(spark, path).select(
        "slot",
        F.octet_length("ids").cast("long").alias("stride"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
    return token_output.read_index(spark, path).drop("text_key").join(sums, "slot")


def op8_sharding(spark, sf_dir):
    ready(spark)
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


def op9_bpe(spark, sf_dir):
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path).drop("text_key")


def op10_license_scan(spark, sf_dir):
    ready(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    ready(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, F.col("source"))


def op12_hard_negatives(spark, sf_dir):
    ready(spark)
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(
        table(spark, sf_dir, "embeddings"),
        is_anchor=vec_id % 100 == 0,
        label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
    )


def op13_spelling_variants(spark, sf_dir):
    ready(spark)
    words = variants.count_words(table(spark, sf_dir, "documents"), variants.misspelt)
    return variants.group_variants(words)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_benchmark_decontamination,
        op3_fingerprints,
        op4_toxicity,
        op5_line_dedup,
        op6_ngram_jaccard_join,
        op7_token_output,
        op8_sharding,
        op9_bpe,
        op10_license_scan,
        op11_packing,
        op12_hard_negatives,
        op13_spelling_variants,
    )
}

ORACLE_SQL = {
    "op2_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s
        FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, s FROM dw JOIN iw USING (n, win)),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
bad AS (
  SELECT source, trim(line, ' ') AS line
  FROM l JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) t
    USING (source)
  WHERE trim(line, ' ') <> ''
  GROUP BY source, trim(line, ' '), pages
  HAVING count(DISTINCT doc_id) >= 3
    AND count(DISTINCT doc_id) > CASE WHEN pages < 30 THEN 0.5 ELSE 0.1 END * pages),
k AS (
  SELECT doc_id, l.source, pos, l.line, bad.line IS NOT NULL AS dropped
  FROM l LEFT JOIN bad ON l.source = bad.source AND trim(l.line, ' ') = bad.line)
SELECT doc_id, source, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
FROM k GROUP BY doc_id, source
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
}


def _license_sql() -> str:
    """The same sentences and rules as SQL values."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    rules = ", ".join(
        f"('{name}', '(^|,){',(.*,)?'.join(ids)}(,|$)')" for name, ids in licenses.RULES
    )
    voids = ", ".join(f"('{a}', '{b}')" for a, b in licenses.VOIDS.items())
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
rules(name, pattern) AS (VALUES {rules}),
voids(longer, shorter) AS (VALUES {voids}),
s AS (
  SELECT doc_id, unnest(list) AS part, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.!?;]([ \t\f\r]|$)', chr(10) || '\1', 'g'), '[.!?;]' || chr(10), chr(10), 'g'), chr(10)) AS list
    FROM documents)),
n AS (
  SELECT doc_id, pos, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM s),
c AS (
  SELECT doc_id, count(*) FILTER (sentence <> '') AS n_sentences,
    coalesce(string_agg(id, ',' ORDER BY pos) FILTER (id IS NOT NULL), '') AS sentence_ids
  FROM n LEFT JOIN known USING (sentence) GROUP BY doc_id),
m AS (
  SELECT doc_id, name FROM c JOIN rules ON regexp_matches(sentence_ids, pattern)
  WHERE sentence_ids <> ''),
f AS (
  SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses
  FROM (SELECT DISTINCT m.doc_id, m.name FROM m
    WHERE NOT EXISTS (SELECT 1 FROM voids v JOIN m o ON o.name = v.longer
      WHERE v.shorter = m.name AND o.doc_id = m.doc_id)) GROUP BY doc_id)
SELECT c.doc_id, n_sentences, sentence_ids, coalesce(licenses, '') AS licenses,
  coalesce(n_licenses, 0) AS n_licenses,
  coalesce((SELECT count(*) FROM m WHERE m.doc_id = c.doc_id), 0) AS n_rules
FROM c LEFT JOIN f USING (doc_id)
"""


ORACLE_SQL["op10_license_scan"] = _license_sql()

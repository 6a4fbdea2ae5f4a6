"""The pipeline's stages on the driver's smallest tables, against brute force."""

from pathlib import Path

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from casestats.llm import queries  # noqa: E402
from casestats.llm.common import stage, table  # noqa: E402
from test_operators import brute_components, contaminated, encoded, pairs  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    out = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF_DIR), name)
        out[name] = docs
    columns = out["documents"].columns
    assert all(df.columns == columns for name, df in out.items() if name != "bpe")
    assert out["toxicity"].count() > 0.75 * out["documents"].count()
    assert out["line_dedup"].count() == out["toxicity"].count()

    # Texts without boilerplate, by the operator's SQL over what the first stage kept.
    con = duckdb.connect()
    con.register("documents", out["toxicity"].toPandas())
    cleaned = con.execute(f"SELECT doc_id, text FROM ({queries.ORACLE_SQL['op5_line_dedup']})")
    assert dict(pairs(out["line_dedup"])) == dict(cleaned.fetchall())

    before = pairs(out["line_dedup"])
    first = {c[0] for c in brute_components(before) if c[0] == c[2]}
    assert {i for i, _ in pairs(out["ngram_jaccard_join"])} == first

    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").collect()]
    clean = {i for i, t in pairs(out["ngram_jaccard_join"]) if not contaminated(t, items)[-1]}
    kept = dict(pairs(out["decontamination"]))
    assert set(kept) == clean

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: tuple(r[1:4]) for r in out["bpe"].collect()}
    assert found == {i: encoded(tokenizer, t) for i, t in kept.items()}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, score double, node long"


def run_stages(spark, folder, rows):
    folder.mkdir()
    extra = ("en", "s", 1, 777, 0.9, 5)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], AWKWARD)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    item = " ".join(f"item{i}" for i in range(13))
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    out, docs = {}, table(spark, str(folder), "documents")
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, str(folder)), name)
        out[name] = docs
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_awkward_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    twice = (1, "a b c d e f g h")
    passage = (5, "so " + " ".join(f"ITEM{i}" for i in range(13)))
    rows = [twice, twice, (2, None), (None, None), (3, ""), (None, "x y"), (4, "x y"), passage, (6, long)]
    out = run_stages(spark, tmp_path / "awkward", rows)
    # Without a label nobody is toxic; no line stands on three pages.
    assert by_id(pairs(out["toxicity"])) == by_id(pairs(out["line_dedup"])) == by_id(rows)
    one_each = [twice, (2, None), (None, None), (3, ""), (4, "x y"), passage, (6, long)]
    assert by_id(pairs(out["ngram_jaccard_join"])) == by_id(one_each)
    clean = [r for r in one_each if r != passage]
    last = out["decontamination"]
    assert by_id(pairs(last)) == by_id(clean)
    assert {(r.n_lines, r.score, r.node) for r in last.collect()} == {(777, 0.9, 5)}
    tokens = {r.doc_id: r.n_tokens for r in out["bpe"].collect()}
    assert tokens[None] == tokens[2] == tokens[3] == 0 and tokens[6] > 30_000


def test_empty_documents(spark, tmp_path):
    out = run_stages(spark, tmp_path / "empty", [])
    assert all(df.count() == 0 for df in out.values())

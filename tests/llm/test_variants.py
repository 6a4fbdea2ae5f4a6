"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casestats.llm import common, variants

# Names of internal columns on purpose: they must not clash.
DDL = "doc_id long, text string, word string, n int, side string, signature string, form int, best int"
FILLER = ("w", 1, "s", "g", 2, 3)


def frame(spark, rows):
    common.ready(spark)
    return spark.createDataFrame([(*r, *FILLER) for r in rows], DDL)


def near(a, b):
    """Whether one inserted, deleted or replaced letter makes `b` of `a`."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def counts(rows, every=97):
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF:
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                out[run if h % every else run[:k] + run[k + 1 :]] += 1
            run = ""
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    out = set()
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(beside[w]), words.get(form[w])))
    return out


def texts(seed):
    rng = random.Random(seed)
    stems = ["colour", "Übermaß", "naïveté", "letters", "aaaaa", "banana", "sorted"]
    alphabet = "abcdelnorstuvzéüÿÀ×÷ß"
    pool = list(stems)
    for _ in range(150):
        w = list(rng.choice(pool))
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) * 2])
        pool.append("".join(w) or "x")
    rows = []
    for i in range(400):
        some = [rng.choice(pool[: 1 + int(len(pool) * rng.random() ** 2)]) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(some)))
    rows += [
        (None, None), (5, None), (6, ""), (7, " \n"), (None, "colour colour colour colours"),
        (8, "colour " * 5000 + "colou" * 3000), (9, rows[0][1]), (9, rows[0][1]),
        (2**60 + 1, "Étranger étranger etranger " * 3),
    ]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, monkeypatch, seed):
    monkeypatch.setattr(variants, "HELD", 40)
    rows = texts(seed)
    words = variants.count_words(frame(spark, rows).repartition(3), variants.misspelt)
    got = variants.group_variants(words)
    found = [tuple(r) for r in got.collect()]
    expected = grouped(counts(rows))
    assert len(found) == len(set(found)) and set(found) == expected
    assert any(root not in (w, form) for w, form, root, *_ in expected)
    assert got.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"),
        ("n_near", "bigint"), ("form_n", "bigint"),
    ]


def test_words_without_change(spark):
    rows = [(1, "Apples apples APPLES pears pears pear")]
    got = variants.count_words(frame(spark, rows), None, min_length=4, min_count=1)
    assert {tuple(r) for r in got.collect()} == {("apples", 3), ("pears", 2), ("pear", 1)}


def test_a_long_way_to_the_root(spark):
    """Counts double with each step, as far as numbers go."""
    words = [("abcde" + "xyzuvwrs"[: k % 8] + "f" * (k // 8), 3 * 2**k) for k in range(40)]
    chain = ["q" * k + "abcde" for k in range(40)]
    words = [(w, 3 * 2**k) for k, w in enumerate(chain)]
    got = variants.group_variants(spark.createDataFrame(words, "word string, n long"))
    assert {tuple(r) for r in got.collect()} == grouped(dict(words))
    assert {r.root for r in got.collect()} == {chain[-1]}


@settings(max_examples=25, deadline=None)
@given(data=st.data())
def test_near_words_share_a_signature(spark, data):
    """All pairs of one example, in one frame."""
    pool = st.text("abcéü", min_size=1, max_size=7)
    words = data.draw(st.lists(pool, min_size=2, max_size=25, unique=True))
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in variants.near_words(df).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_anagrams_of_one_word_do_not_meet(spark):
    """Words of the same letters share no signature unless a half agrees."""
    rng = random.Random(3)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(2000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    signed = variants.signatures(df).filter("side = 0")
    most = signed.groupBy("signature").count().agg({"count": "max"}).first()[0]
    assert most < 20


def test_empty_table(spark):
    words = variants.count_words(frame(spark, []), variants.misspelt)
    assert variants.group_variants(words).count() == 0

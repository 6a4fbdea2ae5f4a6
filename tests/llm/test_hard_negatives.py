"""Hard negatives against all scores, sorted."""

import random

import pytest
from pyspark.sql import functions as F

from casestats.llm import common, hard_negatives

# Names of internal columns on purpose: they must not clash.
DDL = (
    "vec_id long, embedding array<float>, label int, anchor string, part string, q int, "
    "score string, block int, place int, near string, limits int"
)
FILLER = ("a", "p", 1, "s", 2, 3, "n", 4)


def frame(spark, rows):
    common.ready(spark)
    return spark.createDataFrame([(*r, *FILLER) for r in rows], DDL)


def brute(rows, every, positives=5, negatives=10):
    import math

    kept = set()
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None:
            continue
        if any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.add((vec_id, tuple(math.floor(256 * c) for c in x), label))
    out = set()
    for a_id, a, a_label in kept:
        if a_id % every:
            continue
        score = lambda q: sum(x * y for x, y in zip(a, q, strict=False))
        near = sorted({(-score(q), i) for i, q, l in kept if l == a_label and i != a_id})
        far = sorted({(-score(q), i) for i, q, l in kept if l != a_label})
        for minus, positive in near[:positives]:
            p = -minus
            found = [(-s, i) for s, i in far if 30 * p <= -100 * s <= 90 * p][:negatives]
            for rank, (s, i) in enumerate(found, 1):
                out.add((a_id, positive, rank, i, p, s))
    return out


def vectors(seed, n, width=6, labels=3, grain=4):
    """Coarse components, so that many scores are equal."""
    rng = random.Random(seed)
    return [
        (i, [rng.randrange(-2, 2 * grain) / grain for _ in range(width)], rng.randrange(labels))
        for i in range(n)
    ]


NAN, INF = float("nan"), float("inf")
AWKWARD = [
    (None, [1.0] * 6, 0), (300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
    (302, [NAN] * 6, 1), (303, [-INF] * 6, 1), (304, [1.0] * 6, None), (310, [], 1),
    (311, [2.0, 1.0], 0), (312, [1.0] * 9, 2), (320, [1.0] * 6, 0), (320, [1.0] * 6, 0),
    (320, [0.5] * 6, 0), (321, [1.0] * 6, 0), (322, [1.0] * 6, 1), (322, [1.0] * 6, 1), (0, [9.0] * 6, 5),
]


@pytest.mark.parametrize("block_bytes", [10**7, 400])
def test_mining(spark, block_bytes):
    rows = vectors(1, 240) + AWKWARD
    docs = frame(spark, rows).repartition(5)
    got = hard_negatives.mine(docs, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    found = [tuple(r) for r in got.collect()]
    # An id with two vectors is two anchors, whose answers may agree.
    assert set(found) == brute(rows, 10)
    assert got.dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"),
        ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_hot_label_and_ties(spark, monkeypatch, seed):
    """Half of the rows have one label and one vector, so a task must choose often."""
    monkeypatch.setattr(hard_negatives, "PENDING", 50)
    monkeypatch.setattr(hard_negatives, "CELLS", 64)
    rows = vectors(seed, 150, labels=2, grain=1) + [(1000 + i, [0.5] * 6, 1) for i in range(150)]
    got = hard_negatives.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10)


def test_exact_beyond_doubles(spark):
    rows = [
        (0, [3e6, 1.0], 0), (1, [3e6, 2.0], 0), (2, [1e6, 1 / 256], 1), (3, [1e6, 2 / 256], 1),
    ]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10)


def test_scores_beyond_64_bits_are_refused(spark):
    rows = [(0, [1e9, 1.0], 0), (1, [1e9, 2.0], 0)]
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(0, [1.0], 0)], [(0, [1.0], 0), (1, [1.0], 1)]])
def test_nothing_to_find(spark, rows):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.count() == 0

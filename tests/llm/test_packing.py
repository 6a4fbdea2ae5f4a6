"""Packing against a round-robin that is played step by step, and against the library."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from casestats.llm import common, packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
# Names of internal columns on purpose: they must not clash.
DDL = (
    "doc_id long, text string, source string, part int, packet long, size long, band long, "
    "round long, place long, ids string, _block int, length string"
)
ODD = [
    None, "", " \n\t", "one", "It's THE <|endoftext|> end", "日本語 “x” ́é", "é" * 300, "ab " * 5000,
    "x" * 9000,
]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**rng.randrange(1, 6))}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return lambda text: own.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, t, "odd") for i, t in enumerate(ODD)]
    out += [(100 + i, prose(i, rng.randrange(1, 400)), rng.choice("aaab")) for i in range(120)]
    out += [(100, prose(0, 30), "a"), (100, prose(0, 30), "a"), (None, "no id", None), (7, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ready(spark)
    filler = (1, 2, 3, 4, 5, 6, "i", 7, "l")
    return spark.createDataFrame([(*r, *filler) for r in rows], DDL).repartition(4)


def stream(pieces, length):
    """Pieces in the order of the stream; each sequence must be gapless from 0."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    assert sorted(by) == list(range(len(by)))
    out, sizes = [], []
    for number in sorted(by):
        at = 0
        for p in sorted(by[number], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            out.append(p)
        sizes.append(at)
    assert all(s == length or s & (s - 1) == 0 and s < length for s in sizes)
    assert sizes == sorted(sizes, reverse=True)
    return out


def played(packets, targets, length):
    """Deficit round-robin, one round after another. `packets`: source -> sizes in order."""
    whole = sum(targets.values())
    quantum = {s: int(Fraction(t) / whole * length * packing.UNITS) for s, t in targets.items()}
    credit = dict.fromkeys(packets, 0)
    left = {s: list(p) for s, p in packets.items()}
    out, turn = [], 0
    while any(left.values()):
        turn += 1
        for s in sorted(left, key=lambda s: (s is not None, s)):
            credit[s] += quantum[s]
            while left[s] and left[s][0] * packing.UNITS <= credit[s]:
                size = left[s].pop(0)
                credit[s] -= size * packing.UNITS
                out.append((turn, s, size))
    return out


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 6.0, "odd": 2.0, None: 1.0}])
def test_packing(spark, docs, rows, library, targets, length=256, packet=100):
    wanted = targets and spark.createDataFrame(list(targets.items()), "source string, target double")
    out = packing.pack(docs, PATH, F.col("source"), wanted, length, packet, with_ids=True)
    pieces = out.collect()
    ids = defaultdict(list)
    for i, t, s in rows:
        ids[i, s].append(library(t))

    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4
        assert any(
            p.doc_tokens == len(d)
            and p.ids == np.array(d[p.start : p.start + p.length], "<u4").tobytes()
            for d in ids[p.doc_id, p.source]
        )
    # Each id lies in one piece: count the starts of every token place.
    covered = Counter(
        (p.doc_id, p.source, p.doc_tokens, k) for p in pieces for k in range(p.start, p.start + p.length)
    )
    assert covered == Counter(
        (i, s, len(d), k) for (i, s), many in ids.items() for d in many for k in range(len(d))
    )

    # Order: as the round-robin plays it, with the packets in each queue's order.
    placed = stream(pieces, length)
    merged = []
    for p in placed:
        cut = p.start % packet == 0
        if cut:
            merged.append([p.round, p.source, p.length])
        else:
            merged[-1][2] += p.length
    queues = defaultdict(list)
    for _, s, size in merged:
        queues[s].append(size)
    shares = targets or {s: sum(sizes) for s, sizes in queues.items()}
    assert [tuple(m) for m in merged] == played(queues, shares, length)


def test_windows_hold_the_mixture(docs):
    pieces = packing.pack(docs, PATH, F.col("source"), None, 2048, 128).collect()
    total = Counter()
    for p in pieces:
        total[p.source] += p.length
    whole, sent, at = sum(total.values()), Counter(), 0
    for p in stream(pieces, 2048):
        sent[p.source] += p.length
        at += p.length
        for s, n in total.items():
            assert abs(sent[s] - at * n / whole) <= 2048 * n / whole + 2 * 128 * len(total)


def test_sequences(docs, length=256):
    out = packing.pack(docs, PATH, F.col("source"), None, length, 100, with_ids=True)
    pieces = out.collect()
    found = {r.sequence_id: r for r in packing.sequences(out.sparkSession.createDataFrame(pieces, out.schema)).collect()}
    for p in pieces:
        r = found[p.sequence_id]
        assert bytes(r.ids[4 * p.offset : 4 * (p.offset + p.length)]) == p.ids
        assert (p.doc_id, p.start, p.offset, p.length) in [tuple(d) for d in r.docs]
    assert all(len(r.ids) == 4 * r.n_tokens for r in found.values())


def test_a_source_without_target_is_refused(spark, docs):
    wanted = spark.createDataFrame([("a", 1.0)], "source string, target double")
    with pytest.raises(Exception, match="no target"):
        packing.pack(docs, PATH, F.col("source"), wanted).collect()


def test_empty_table(spark):
    common.ready(spark)
    empty = spark.createDataFrame([], DDL)
    assert packing.pack(empty, PATH, F.col("source")).count() == 0


def test_one_document_without_text(spark):
    common.ready(spark)
    one = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    (row,) = packing.pack(one, PATH, F.col("source")).collect()
    crc = zlib.crc32(np.array([2], "<u4").tobytes())
    assert row[:8] == (1, "s", 0, 1, crc, 1, 0, 0)


def test_borders():
    assert packing.borders(4096 * 3, 4096) == []
    assert packing.borders(4096 + 13, 4096) == [4096, 4104, 4108]
    assert packing.borders(0, 4096) == []


def test_words_equal_the_library(library):
    own = packing.words_of(*packing.read_vocabulary(PATH))
    assert own.apart and own.merger
    rng = random.Random(1)
    letters = "aB'sStTrReElLdDmM  \n\t\x0b\x0c\x1c\x85\xa0éÉßÿÞ×÷0129²½ªº_-!.<|>ıİſΣς’本́ǅ\0"
    for k in range(4000):
        some = letters if k % 2 else letters[:40]
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        text += "<|endoftext|>" * (k % 19 == 0)
        assert [*own.ids(text).tolist(), 2] == library(text)


def test_other_vocabularies_are_encoded_whole():
    file = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.Words(*packing.read_vocabulary(file))
    text = "Some text,  with blanks\n and é."
    assert not own.apart
    plain = tokenizers.Tokenizer.from_file(file)
    assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_unsettled_merges():
    def said(merges, vocab):
        model = {"type": "BPE", "end_of_word_suffix": "</w>", "merges": merges}
        return {"model": model | {"vocab": {t: i for i, t in enumerate(vocab)}}}

    letters = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    assert packing.settled(said(["a b", "ab c"], [*letters, "ab", "abc"]))
    # "abc" merged by itself stops at a, bc
    assert not packing.settled(said(["b c", "a b", "ab c"], [*letters, "bc", "ab", "abc"]))

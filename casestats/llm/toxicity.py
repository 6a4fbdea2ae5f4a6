"""Toxicity by nearest labelled examples.

A text is the TF-IDF vector of all its words that examples have, with document frequencies
counted over all documents. A word weighs `FLOOR` plus the root of its log-likelihood gain if
it is commoner in toxic examples: no word is left out, so every text with a word of any example
has neighbours. The k nearest examples by exact cosine come from a block-max inverted index:
the lists of all words but the commonest are read; then the greatest weights of the commonest
in each block tell which examples can still be among the nearest. If these are few they are
scored in full; else what the commonest words add to every example is a product of matrices, for
many texts at once, and the examples that it leaves are scored in full. Votes weigh by closeness
and pass through a monotone calibration fitted on the examples' own leave-one-out votes; the ids
of the nearest examples are the evidence.

Examples are a bounded sample of labelled rows in the order of an id hash: at most
`MAX_EXAMPLES` rows whose whole texts have at most `MAX_EXAMPLE_BYTES` together; a text above a
sixteenth of those bytes is no example. The index, its vocabulary and the calibration are
therefore bounded and go to every task. Everything counted over the corpus covers all of it.

NULL and empty texts, and texts without a word of any example, get the share of toxic labels
among the examples without a word, or among all if there is none. Labels of one id that
disagree count as toxic; rows with a NULL label are no examples. With no usable label every
score is 0. Repeated rows get equal results, and are one example.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casestats.llm.common import (
    KEY, drop_staged, join_keyed, keyed, let_go, once, slices, stage, without_rows,
)

MAX_EXAMPLES = 20_000
MAX_EXAMPLE_BYTES = 128 << 20
FLOOR = 0.1
NEAREST = 25
BLOCK = 64
# Words whose weights are kept for every example: so many at most, each in this share of the
# examples or more. The others have lists.
COMMON, COMMON_SHARE = 512, 1 / 32
# Texts whose products with these are made at once.
TOGETHER = 128
# Products that cost as much as one entry of an example scored in full.
PRODUCTS = 256
# Far above what single precision rounds away in a sum of that many products.
SLACK = 1e-4
PRIOR_WEIGHT = 1.0
# Examples whose votes one task counts.
VOTES = 2_500
WORD = re.compile(r"[^\W\d_]+")


@cache
def letters() -> np.ndarray:
    """Whether each code point stands in words."""
    known = np.zeros(sys.maxunicode + 1, bool)
    for found in WORD.finditer("".join(map(chr, range(len(known))))):
        known[found.start() : found.end()] = True
    return known


def words_of(text: str | None) -> list[str]:
    """The matches of `WORD` in lower case; all else becomes blanks, as a search takes longer."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[codes], codes, np.uint32(32))
    return codes.tobytes().decode("utf-32-le", "surrogatepass").split()


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples(
    docs: DataFrame,
    labels: DataFrame,
    limit: int = MAX_EXAMPLES,
    max_bytes: int = MAX_EXAMPLE_BYTES,
) -> DataFrame:
    """(doc_id, text_key, toxic) of at most `limit` labelled rows with `max_bytes` of text."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_doc_id"), "_doc_id")
        .limit(limit)
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = keyed(docs).select(*KEY, size.alias("size")).filter(F.col("size") <= max_bytes // 16)
    order = [F.xxhash64("doc_id"), "doc_id", "text_key"]
    taken = (
        rows.join(F.broadcast(known), rows["doc_id"] == F.col("_doc_id"))  # within `limit` ids
        .select(*KEY, "size", "toxic")
        .distinct()
        .orderBy(*order)
        .limit(limit)
    )
    # At most `limit` narrow rows, so one task may sum them.
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return taken.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select(*KEY, "toxic")


def list_vocabulary(docs: DataFrame, chosen: DataFrame) -> pa.Array:
    """All words of the examples, sorted; their texts' bytes bound them."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            words = set().union(*(words_of(text) for text in batch["text"]))
            yield pd.DataFrame({"word": list(words)})

    texts = join_keyed(keyed(docs), F.broadcast(chosen.select(*KEY)), "left_semi")
    words = texts.select("text").mapInPandas(listed, "word string").distinct()
    found = words.toArrow()["word"].combine_chunks()
    return found.take(pc.sort_indices(found))


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, text_key, ids, counts): the vocabulary's words in every text."""
    shared, name = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = once(name, lambda: {w: i for i, w in enumerate(shared.value.to_pylist())})
        for batch in slices(batches):
            ids, counts = [], []
            for text in batch["text"]:
                words = words_of(text)
                own = np.fromiter(map(number.get, words, repeat(-1)), "int32", len(words))
                own, n = np.unique(own[own >= 0], return_counts=True)
                ids.append(own)
                counts.append(n)
            out = batch[KEY].copy()
            out["ids"], out["counts"] = ids, counts
            yield out

    schema = "doc_id long, text_key long, ids array<int>, counts array<int>"
    return keyed(docs).mapInPandas(found, schema)


@dataclass
class Examples:
    """The examples' words, one row after the other; row i ends at `ends[i]`."""

    doc_ids: list[int]
    toxic: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    idf: np.ndarray

    @classmethod
    def collected(cls, rows: DataFrame, idf: np.ndarray) -> Examples:
        """From (doc_id, toxic, ids, counts), whose size the sample's bounds limit."""
        table = rows.toArrow().combine_chunks()
        lengths = pc.list_value_length(table["ids"]).to_numpy()
        ids, counts = (pc.list_flatten(table[c]).to_numpy() for c in ("ids", "counts"))
        # Each worker holds them: in the smallest type.
        counts = counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))
        toxic = (table["toxic"].to_numpy() > 0).astype("int64")
        return cls(table["doc_id"].to_pylist(), toxic, ids, counts, np.cumsum(lengths), idf)


def word_weights(examples: Examples) -> np.ndarray:
    """FLOOR, plus the root of the log-likelihood gain where a word is commoner in toxic
    examples than in all."""
    size, rate = len(examples.idf), examples.toxic.mean() if len(examples.toxic) else 0.0
    if not 0 < rate < 1:
        return np.ones(size)
    label = np.repeat(examples.toxic, np.diff(examples.ends, prepend=0))
    total = np.bincount(examples.ids, minlength=size).astype(float)
    toxic = np.bincount(examples.ids, label, size)

    def part(x, p):
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, total * p, 1))

    gain = np.maximum(2 * (part(toxic, rate) + part(total - toxic, 1 - rate)), 0)
    return FLOOR + np.sqrt(np.where(toxic > rate * total, gain, 0))


def weigh(ids, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of (1 + ln tf) * idf."""
    ids = np.asarray(ids, "int32")
    w = (1 + np.log(np.asarray(counts, float))) * idf[ids]
    norm = np.sqrt((w * w).sum())
    return ids, w / norm if norm else w


def weigh_all(ids, counts, ends, idf: np.ndarray) -> np.ndarray:
    """`weigh` of rows one after the other, none of them empty."""
    if not len(ids):
        return np.empty(0)
    w = np.log(counts.astype(float))
    w += 1
    w *= idf[ids]
    lengths = np.diff(ends, prepend=0)
    norms = np.sqrt(np.add.reduceat(w * w, ends - lengths))
    w /= np.repeat(norms, lengths)
    return w


class BlockMaxIndex:
    """Inverted lists over the examples; the weights of the commonest words in every example,
    with the greatest in each block of examples.

    Examples that share their commonest words stand together, so that blocks differ.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        ends = np.cumsum([len(ids) for ids, _ in rows], dtype="int64")
        ids = np.concatenate([np.empty(0, "int32"), *(ids for ids, _ in rows)])
        self.fill(ids, np.concatenate([np.empty(0), *(w for _, w in rows)]), ends, size)

    @classmethod
    def of_counts(cls, ids, counts, ends, idf: np.ndarray) -> BlockMaxIndex:
        """Of rows that stand one after the other, not yet weighed; row i ends at `ends[i]`."""
        index = cls.__new__(cls)
        index.fill(ids, counts, ends, len(idf), idf)
        return index

    def fill(self, ids, values, ends, size: int, idf: np.ndarray | None = None) -> None:
        """`values` are weights, or counts to be weighed by `idf`, which stay counts. Whole
        columns at a time, dropped as soon as they are used: each worker holds them."""
        self.n, self.size, self.idf = len(ends), size, idf
        lengths = np.diff(ends, prepend=0)
        begun = ends - lengths
        df = np.bincount(ids, minlength=size)

        def common(i):
            own = ids[begun[i] : ends[i]]
            return tuple(own[np.argsort(-df[own], kind="stable")[:3]].tolist())

        self.row = np.array(sorted(range(self.n), key=common), "int64")
        self.place = np.argsort(self.row, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(lengths[self.row])]).astype("int64")
        self.words = np.empty(len(ids), "int32")
        if idf is not None:
            most = int(values.max()) if len(values) else 0
            # What a count weighs before `idf`.
            self.tf = 1 + np.log(np.maximum(np.arange(most + 1), 1).astype(float))
            values = values.astype(np.min_scalar_type(most), copy=False)
        self.values = np.empty(len(ids), values.dtype)
        self.norms = np.ones(self.n)
        often = np.argsort(-df, kind="stable")[:COMMON]
        often = often[df[often] >= max(self.n * COMMON_SHARE, 1)]
        self.column = np.full(size, -1, "int32")
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), "float32")
        self.starts = np.concatenate([[0], np.cumsum(np.where(self.column < 0, df, 0))]).astype("int64")
        word = np.empty(self.starts[-1], "int32")
        # Place and weight side by side, as they are read together.
        entries = np.empty((len(word), 2), "int32")
        weights = entries.view("float32")[:, 1]
        done = 0
        for at, i in enumerate(self.row.tolist()):
            part = slice(self.ends[at], self.ends[at + 1])
            own = self.words[part] = ids[begun[i] : ends[i]]
            self.values[part] = values[begun[i] : ends[i]]
            w = self.values[part]
            if idf is not None and len(own):
                w = self.tf[w] * idf[own]
                self.norms[at] = np.sqrt(np.add.reduceat(w * w, [0])[0])
                w /= self.norms[at]
            column = self.column[own]
            listed = column < 0
            self.dense[column[~listed], at] = w[~listed]
            to = slice(done, done := done + int(listed.sum()))
            word[to], entries[to, 0], weights[to] = own[listed], at, w[listed]
        by_word = np.argsort(word, kind="stable")
        del word, weights
        self.entries = entries.view("int64")[:, 0][by_word]
        del entries, by_word
        self.blocks = np.arange(self.n, dtype="int32") // np.int32(BLOCK)
        self.block_starts = np.arange(0, self.n, BLOCK)
        self.most = self.dense[:, :0]
        if self.n:
            self.most = np.maximum.reduceat(self.dense, self.block_starts, axis=1)
        self.peak = self.most.max(axis=1, initial=0)
        self.length = len(self.words) / max(self.n, 1)
        self.scratch = None

    @property
    def places(self) -> np.ndarray:
        return self.entries.view("int32")[::2]

    @property
    def weights(self) -> np.ndarray:
        return self.entries.view("float32")[1::2]

    @property
    def exact(self) -> np.ndarray:
        """The weights of all rows, one after the other."""
        return self.weighed(slice(None), np.repeat(self.norms, np.diff(self.ends)))

    def weighed(self, part: slice, norms) -> np.ndarray:
        """Exact weights of what stands there, in rows of these norms."""
        if self.idf is None:
            return self.values[part]
        w = self.tf[self.values[part]]
        w *= self.idf[self.words[part]]
        w /= norms
        return w

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row i's words and weights."""
        at = self.place[i]
        part = slice(self.ends[at], self.ends[at + 1])
        return self.words[part].astype("int64"), self.weighed(part, self.norms[at])

    def scores(self, places, ids, weights) -> np.ndarray:
        """Exact cosines of the examples at these places."""
        if self.scratch is None:
            self.scratch = np.zeros(self.size)
        lo, hi = self.ends[places], self.ends[places + 1]
        parts = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        values = np.concatenate([self.values[part] for part in parts])
        self.scratch[ids] = weights if self.idf is None else weights * self.idf[ids]
        products = self.scratch[np.concatenate([self.words[part] for part in parts])]
        self.scratch[ids] = 0
        products *= values if self.idf is None else self.tf[values]
        return np.add.reduceat(products, np.cumsum(hi - lo) - (hi - lo)) / self.norms[places]

    def nearest(self, ids, weights, k: int, leave_out: int = -1):
        """Row numbers and cosines of the k nearest rows with a cosine above 0, nearest
        first, equal ones by row number."""
        return self.all_nearest([(ids, weights)], k, [leave_out])[0]

    def all_nearest(self, queries: list, k: int, leave_out: list[int] | None = None) -> list:
        """`nearest` of each (ids, weights)."""
        found: list = [(np.empty(0, "int64"), np.empty(0))] * len(queries)
        if not self.n:
            return found
        # Texts that share their commonest word have few common words and blocks together.
        first = [self.column[ids][self.column[ids] >= 0].min(initial=COMMON) for ids, _ in queries]
        order = np.argsort(first, kind="stable").tolist()
        for start in range(0, len(order), TOGETHER):
            some = order[start : start + TOGETHER]
            out = [leave_out[i] if leave_out else -1 for i in some]
            for i, rows in zip(some, self.some_nearest([queries[i] for i in some], k, out), strict=True):
                found[i] = rows
        return found

    def some_nearest(self, queries: list, k: int, leave_out: list[int]) -> list:
        common = np.zeros((len(queries), len(self.dense)), "float32")
        least = np.empty((len(queries), self.n), "float32")
        for sums, often, out, (ids, weights) in zip(least, common, leave_out, queries, strict=True):
            column = self.column[ids]
            listed = column < 0
            often[column[~listed]] = weights[~listed]
            sums[:] = self.summed(ids[listed], weights[listed])
            if out >= 0:
                sums[self.place[out]] = 0
        bounds = common @ self.most
        left = [self.left_by_bounds(*row, k) for row in zip(least, bounds, queries, strict=True)]
        some = [j for j, places in enumerate(left) if places is None]
        used = np.flatnonzero(common[some].any(axis=0))
        if 4 * len(used) > 3 * len(self.dense):
            products = common[some] @ self.dense
        else:
            products = common[np.ix_(some, used)] @ self.dense[used]
        for j, sums in zip(some, products, strict=True):
            sums += least[j]
            if leave_out[j] >= 0:
                sums[self.place[leave_out[j]]] = 0
            left[j] = self.left_by_sums(sums, k)
        return [self.best(*row, k) for row in zip(left, queries, leave_out, strict=True)]

    def summed(self, words, weights) -> np.ndarray:
        """What these words add to each example by their lists."""
        if not len(words):
            return np.zeros(self.n)
        lo, hi = self.starts[words], self.starts[words + 1]
        parts = zip(lo.tolist(), hi.tolist(), strict=True)
        read = np.concatenate([self.entries[a:b] for a, b in parts])
        found = read.view("float32")[1::2] * np.repeat(weights, hi - lo)
        return np.bincount(read.view("int32")[::2], found, self.n)

    def left_by_bounds(self, least, bounds, query, k: int):
        """Places of the rows that can be among the nearest by what the listed words add and
        the bounds of the common ones; None if scoring them costs more than the product."""
        if bounds.max(initial=0) == 0:
            return self.left_by_sums(least, k)
        kth, greatest = self.bar(least, k)
        # Where half of the blocks are open by a low bar, a higher one seldom leaves few rows.
        if kth <= 0 or 2 * (greatest + bounds >= kth - SLACK).sum() > len(bounds):
            return None
        top = np.flatnonzero(least >= kth)
        top = top[np.argpartition(least[top], -k)[-k:]]
        kth = self.scores(top, *query).min()  # whole scores are a higher bar
        left = np.flatnonzero(least + bounds[self.blocks] >= kth - SLACK)
        few = len(left) * self.length * PRODUCTS <= self.dense.size
        return left if few else None

    def left_by_sums(self, sums, k: int) -> np.ndarray:
        """Places of the rows that can be among the nearest by their rounded cosines."""
        kth, _ = self.bar(sums, k)
        left = np.flatnonzero((sums >= kth - SLACK) & (sums > 0))
        if len(left) > k:
            near = sums[left]
            left = left[near >= np.partition(near, -k)[-k] - SLACK]
        return left

    def bar(self, sums, k: int):
        """What k rows reach, or 0; and the greatest sum of each block. The k greatest sums are
        not below the k-th greatest of the blocks'."""
        greatest = np.maximum.reduceat(sums, self.block_starts)
        of = greatest if len(greatest) >= k else sums
        return np.partition(of, -k)[-k] if len(of) >= k else 0, greatest

    def best(self, left, query, leave_out: int, k: int):
        left = left[self.row[left] != leave_out]
        if not len(left):
            return left, np.empty(0)
        scores, rows = self.scores(left, *query), self.row[left]
        best = np.lexsort((rows, -np.round(scores, 12)))[:k]
        best = best[scores[best] > 0]
        return rows[best], scores[best]


class Scorer:
    """The index over the examples with its votes; `x` and `y` are the calibration's steps."""

    def __init__(self, examples: Examples):
        e = examples
        self.idf = e.idf * word_weights(e)
        starts = e.ends - np.diff(e.ends, prepend=0)
        filled = np.flatnonzero(e.ends > starts)
        bare = e.toxic[e.ends == starts]
        self.rate = float(e.toxic.mean()) if len(e.toxic) else 0.0
        self.bare = float(bare.mean()) if len(bare) else self.rate
        self.doc_ids = [e.doc_ids[i] for i in filled]
        self.toxic = e.toxic[filled].astype(float)
        self.index = BlockMaxIndex.of_counts(e.ids, e.counts, e.ends[filled], self.idf)
        self.x = self.y = np.empty(0)

    def own_votes(self, rows: list[int]) -> list[float]:
        """The votes on examples, each by the others."""
        found = []
        for start in range(0, len(rows), TOGETHER):
            some = rows[start : start + TOGETHER]
            found += [vote for vote, _ in self.count_votes([self.index.vector(i) for i in some], some)]
        return found

    def count_votes(self, queries: list, leave_out: list[int] | None = None) -> list:
        votes = []
        for rows, close in self.index.all_nearest(queries, NEAREST, leave_out):
            w = close**2
            vote = (w @ self.toxic[rows] + PRIOR_WEIGHT * self.rate) / (w.sum() + PRIOR_WEIGHT)
            votes.append((vote, [self.doc_ids[i] for i in rows[:3]]))
        return votes

    def score(self, texts: list) -> list[tuple[float, list]]:
        """Score and evidence of each (ids, counts)."""
        some = [weigh(ids, counts, self.idf) for ids, counts in texts if len(ids)]
        votes = iter(self.count_votes(some))
        return [self.judged(*next(votes)) if len(ids) else (self.bare, []) for ids, _ in texts]

    def judged(self, vote: float, evidence: list) -> tuple[float, list]:
        return float(np.interp(vote, self.x, self.y)) if len(self.x) else self.rate, evidence


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a never falling step function fitted to (x, y) by pooling neighbours."""
    pools: list[list[float]] = []  # mean x, mean y, weight
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i], y[i], 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            bx, by, bw = pools.pop()
            ax, ay, aw = pools[-1]
            w = aw + bw
            pools[-1] = [(ax * aw + bx * bw) / w, (ay * aw + by * bw) / w, w]
    # One observation of each label keeps pools of few examples off 0 and 1.
    return np.array([p[0] for p in pools]), np.array(
        [(p[1] * p[2] + 1) / (p[2] + 2) for p in pools]
    )


def own_votes(spark: SparkSession, name: str, shared, n: int) -> np.ndarray:
    """Every example's vote by the others, as a job over the `n` examples with words."""

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judge = once(name, lambda: Scorer(shared.value))
            yield batch.assign(vote=judge.own_votes(batch["id"].tolist()))

    votes = spark.range(0, n, 1, -(-n // VOTES) or 1).mapInPandas(voted, "id long, vote double")
    # Within the sample's size; as columns, since a row is a Python object on the driver.
    return votes.toArrow().sort_by("id")["vote"].to_numpy()


def score_documents(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted, evidence (nearest examples)."""
    return scores_until(docs, labels, limit)[0]


def scores_until(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, Callable]:
    """The scores, and what deletes the vectors and examples they are made of, to be called when
    nobody reads them any more."""
    spark = docs.sparkSession
    chosen = stage(examples(docs, labels, limit), "toxicity_examples")
    vocabulary = list_vocabulary(docs, chosen)
    every = stage(vectors(docs, vocabulary), "toxicity_vectors")
    n, *_ = every.agg(F.count(F.lit(1))).first()
    counted = every.select(F.explode("ids").alias("i")).groupBy("i").count().toArrow()
    df = np.zeros(len(vocabulary))
    df[counted["i"].to_numpy()] = counted["count"].to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    del counted, vocabulary  # the driver keeps numbers only
    found = join_keyed(every, F.broadcast(chosen), "inner")  # within `limit` rows
    rows = found.dropDuplicates(KEY).orderBy(KEY).select("doc_id", "toxic", "ids", "counts")
    learnt = Examples.collected(rows, idf)
    drop_staged(chosen)
    shared, name = spark.sparkContext.broadcast(learnt), uuid.uuid4().hex
    toxic = learnt.toxic[np.diff(learnt.ends, prepend=0) > 0].astype(float)
    steps = isotonic(own_votes(spark, name, shared, len(toxic)), toxic)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for batch in slices(batches, 2_000):
            judge = once(name, lambda: Scorer(shared.value))
            judge.x, judge.y = steps
            # Equal texts have one key, but so may others: the sizes are compared too.
            keys = [
                (text, len(ids), int(np.sum(counts)))
                for text, ids, counts in zip(batch["text_key"], batch["ids"], batch["counts"], strict=True)
            ]
            if len(known) > 50_000:
                known.clear()
            rows = zip(keys, batch["ids"], batch["counts"], strict=True)
            new = {key: (ids, counts) for key, ids, counts in rows if key not in known}
            known |= zip(new, judge.score(list(new.values())), strict=True)
            found = [known[key] for key in keys]
            out = batch[KEY].copy()
            out["score"] = [s for s, _ in found]
            out["evidence"] = [e for _, e in found]
            yield out

    result = every.mapInPandas(
        scored, "doc_id long, text_key long, score double, evidence array<long>"
    )
    result = result.select(
        *KEY,
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )

    def done():
        drop_staged(every)
        shared.destroy()

    return result, done


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` not predicted toxic, with all their columns."""
    scores, done = scores_until(docs, labels, MAX_EXAMPLES)
    kept = without_rows(docs, scores.filter("predicted = 1"))  # writes the keys
    let_go(docs.sparkSession)
    done()
    return kept

"""Hard negatives: rows of another label that score within a window below a positive.

A positive with score p allows negatives from 0.3 p to 0.9 p. The upper limits of an anchor's
positives cut the scores into disjoint slots, highest first. Tasks keep the best K rows of
each slot and nothing else, and the same is done where tasks meet. A positive's answer starts
in its own slot and goes on through the lower ones, so one merge from the lowest slot upwards
answers all windows, however they overlap.

All rows are scored against all anchors, block by block: a block of anchors is sent to the
tasks, each of which multiplies it with its own rows.

Rows with a NULL id, label or vector, or with a NULL or non-finite component take no part. A
shorter vector counts as padded with zeros. Equal rows count once, as an anchor, a positive or
a negative; rows that share an id but not the vector are anchors of their own. A row is never
a positive of an anchor with its own id. An anchor without positives, and a positive without
negatives in its window, give no rows, and an empty table gives an empty result. Scores beyond
64 bits are refused. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestats.llm.common import stage

POSITIVES, NEGATIVES = 5, 10
# A negative's score in hundredths of its positive's.
LOWEST, HIGHEST = 30, 90

# Anchors that are scored in one pass: about so many bytes are broadcast at a time.
BLOCK_BYTES = 32_000_000
# Scores held at once by a task, and rows kept before the best are chosen among them.
CELLS, PENDING = 2_000_000, 500_000

LEAST = np.iinfo("int64").min


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, q): rows that take part, components as floor(256 x)."""
    x = F.col("embedding")
    whole = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    return vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("q"),
    )


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of `width` components; shorter ones are padded, longer ones cut."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), "int64")
    row = np.repeat(np.arange(len(lists)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = column < width
    out[row[inside], column[inside]] = flat[inside]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), "int64")
    greatest = [max(abs(int(m.min())), abs(int(m.max()))) for m in (rows, anchors)]
    bound = greatest[0] * greatest[1] * rows.shape[1]
    if bound >= 2**63:
        raise ValueError("scores beyond 64 bits")
    if bound < 2**53:  # whole numbers that a double holds exactly
        return (rows.astype("float64") @ anchors.T.astype("float64")).astype("int64")
    return rows @ anchors.T


class Best:
    """The best `k` (score, id) of each group; higher scores, then smaller ids, come first."""

    def __init__(self, groups: int, k: int):
        self.k = k
        # A group's k-th best score: lower ones need not be looked at.
        self.floor = np.full(groups, LEAST, "int64")
        self.kept = [np.empty(0, "int64")] * 3
        self.new: list[tuple] = []
        self.pending = 0

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.new.append((group, score, row))
        self.pending += len(group)
        if self.pending > PENDING:
            self.choose()

    def choose(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(self.kept, *self.new, strict=True)]
        order = np.lexsort((columns[2], -columns[1], columns[0]))
        group, score, row = (c[order] for c in columns)
        first = np.ones(len(group), bool)
        first[1:] = (np.diff(group) != 0) | (np.diff(score) != 0) | (np.diff(row) != 0)
        group, score, row = group[first], score[first], row[first]
        begins = np.flatnonzero(np.r_[True, np.diff(group) != 0])[: len(group)]
        sizes = np.diff(np.r_[begins, len(group)])
        place = np.arange(len(group)) - np.repeat(begins, sizes)
        best = place < self.k
        self.kept = [group[best], score[best], row[best]]
        last = place == self.k - 1
        self.floor[group[last]] = score[last]
        self.new, self.pending = [], 0
        return self.kept


def best_by_task(
    rows: DataFrame, anchors: dict, groups: int, k: int, select: Callable
) -> DataFrame:
    """(anchor, part, score, vec_id): each task's best `k` rows of every anchor's `groups`
    parts.

    `select(scores, labels, ids, anchors, floor)` gives the cells of a score table that count,
    as (row, anchor, part), leaving out what is below the floor of its part.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n, width = own["q"].shape
        best = Best(n * groups, k)
        step = max(1, CELLS // max(1, n))
        for batch in batches:
            q = matrix(batch["q"], width)
            ids, labels = (batch[c].to_numpy() for c in ("vec_id", "label"))
            for at in range(0, len(ids), step):
                cut = slice(at, at + step)
                scores = products(q[cut], own["q"])
                row, anchor, part = select(
                    scores, labels[cut], ids[cut], own, best.floor.reshape(n, groups)
                )
                best.add(anchor * groups + part, scores[row, anchor], ids[cut][row])
        group, score, row = best.choose()
        for at in range(0, len(group), 50_000):
            cut = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own["anchor"][group[cut] // groups]),
                    pa.array((group[cut] % groups).astype("int32")),
                    pa.array(score[cut]),
                    pa.array(row[cut]),
                ],
                names=["anchor", "part", "score", "vec_id"],
            )

    return rows.select("vec_id", "label", "q").mapInArrow(
        scored, "anchor long, part int, score long, vec_id long"
    )


def same_label(scores, labels, ids, own, floor):
    """Rows of the anchor's label other than itself."""
    good = labels[:, None] == own["label"][None, :]
    good &= ids[:, None] != own["vec_id"][None, :]
    good &= scores >= floor[None, :, 0]
    row, anchor = np.nonzero(good)
    return row, anchor, np.zeros(len(row), "int64")


def other_label(scores, labels, ids, own, floor):
    """Rows of another label, by slot: the lowest limit that is not below the score."""
    good = labels[:, None] != own["label"][None, :]
    good &= scores <= own["limits"][None, :, 0]
    good &= scores >= own["least"][None, :]
    row, anchor = np.nonzero(good)
    score = scores[row, anchor]
    slot = (score[:, None] <= own["limits"][anchor]).sum(axis=1) - 1
    good = score >= floor[anchor, slot]
    return row[good], anchor[good], slot[good]


def block(anchors: DataFrame, number: int) -> dict:
    """One block of anchors as arrays."""
    table = anchors.filter(F.col("block") == number).drop("block").toArrow()
    out = {}
    for name in table.column_names:
        column = table[name].combine_chunks()
        if not pa.types.is_list(column.type):
            out[name] = column.to_numpy()
        else:
            widest = max(np.diff(column.offsets.to_numpy()), default=0)
            out[name] = matrix(column, int(widest))
    return out


def by_block(
    rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, k: int, select: Callable,
    name: str,
) -> DataFrame:
    """The best `k` rows of each anchor's parts: per task, then over all tasks."""
    found = []
    for number in range(blocks):
        own = block(anchors, number)
        if len(own["anchor"]):
            found.append(stage(best_by_task(rows, own, groups, k, select), f"{name}_{number}"))
    if not found:
        return rows.sparkSession.createDataFrame(
            [], "anchor long, part int, score long, vec_id long"
        )
    best = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "vec_id")
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("place", F.dense_rank().over(best))
        .filter(F.col("place") <= k)
        .select("anchor", "part", "score", "vec_id")
        .distinct()
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for a table
    (vec_id, embedding, label)."""
    rows = quantised(vectors, F.col("label") if label is None else label)
    anchors = stage(
        rows.filter(is_anchor).distinct().withColumn("anchor", F.xxhash64("vec_id", "label", "q")),
        "anchors",
    )
    size = anchors.agg(F.sum(8 * (F.size("q") + 3))).first()[0] or 0
    blocks = -(-size // block_bytes)
    number = F.pmod("anchor", F.lit(max(1, blocks))).cast("int")
    anchors = anchors.withColumn("block", number)

    near = stage(
        by_block(rows, anchors, blocks, 1, positives, same_label, "positives").select(
            "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    near = near.select(
        "anchor", "positive_id", "positive_score",
        F.negative(_hundredth(-LOWEST)).alias("lower"), _hundredth(HIGHEST).alias("upper"),
    )
    # At most `positives` rows an anchor; equal limits make one slot.
    windows = near.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"),
        F.min("lower").alias("least"),
        F.collect_list(F.struct("positive_id", "positive_score", "lower", "upper")).alias("near"),
    )
    windows = stage(windows, "windows")
    # Padding with the lowest number: no score is at or below it.
    filled = F.concat("limits", F.array_repeat(F.lit(int(LEAST)), positives))
    targets = anchors.join(
        windows.select("anchor", "least", F.slice(filled, 1, positives).alias("limits")), "anchor"
    )
    slots = by_block(rows, targets, blocks, positives, negatives, other_label, "negatives")
    merged = slots.groupBy("anchor").agg(
        F.sort_array(
            F.collect_list(F.struct(F.negative("score").alias("minus"), "vec_id", "part"))
        ).alias("best")
    )
    return (
        windows.join(merged, "anchor")
        .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "limits", "best", F.explode("near").alias("own"))
        .select(
            "anchor_id",
            F.col("own.positive_id"),
            F.col("own.positive_score"),
            F.posexplode(_answer(negatives)).alias("place", "found"),
        )
        .select(
            "anchor_id",
            "positive_id",
            (F.col("place") + 1).alias("rank"),
            F.col("found.vec_id").alias("negative_id"),
            "positive_score",
            F.negative("found.minus").alias("negative_score"),
        )
    )


def _hundredth(factor: int) -> Column:
    """floor(factor * positive_score / 100) in whole numbers, of whole hundreds and the rest."""
    rest = "pmod(positive_score, 100)"
    return F.expr(
        f"(positive_score - {rest}) div 100 * {factor} + cast(floor({factor} * {rest} / 100) AS long)"
    )


def _answer(negatives: int) -> Column:
    """From the positive's slot downwards, the first rows; then what its window excludes goes.
    Rows are in descending order of score, so the lower limit cuts off an end."""
    slot = F.array_position("limits", F.col("own.upper")) - 1
    downwards = F.filter("best", lambda b: b["part"] >= slot)
    return F.filter(
        F.slice(downwards, 1, negatives), lambda b: -b["minus"] >= F.col("own.lower")
    )

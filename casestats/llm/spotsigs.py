"""Document fingerprints by SpotSigs.

A signature is a common word (the anchor) with the two content words that follow it; the
fingerprint is the sorted set of a text's signatures, eight hexadecimal digits each. Texts
with words but without a full chain have one signature, of all their words. Likeness is the
Jaccard value of two sets. `near_duplicates` links sets of 0.8 or more. Sets are partitioned by
length so that partners stand in the same or in the next partition; there they meet in inverted
lists of their rarest signatures, lengths and places in the lists' order bound what they can
share, and the pairs left are compared exactly. Equal sets are one; each set is first compared
with the least one of its lists, and only sets of different components are then paired.

The next document in descending order of ids is found by sorting ranges of ids: a range is
read in order, one row ahead, and is handed a copy of the first row of the following one.

NULL counts as empty: no signatures, fingerprint "". Two empty sets are alike (1). NULL ids
come last; rows with equal ids follow each other by a hash of the text, repeated rows too.
A single document is its own next one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestats.llm.common import KEY, drop_staged, if_small, keyed, release, slices, stage
from casestats.llm.ngram_join import components

# Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "das dem den der die ein eine ist mit nicht sich sie und von zu im für auf "
    "al con del el es los las lo no para por se su una y".split()
)
CHAIN = 2
WORD = re.compile(r"\w+")


def signatures(text: str | None) -> set[str]:
    words = WORD.findall((text or "").lower())
    content: list[str] = []
    spots = []
    for word in words:
        if word in ANCHORS:
            spots.append((word, len(content)))
        else:
            content.append(word)
    last = len(content) - CHAIN
    digest = xxhash.xxh32_hexdigest
    found = {digest(f"{w} {content[k]} {content[k + 1]}") for w, k in spots if k <= last}
    return found or ({digest(" ".join(words))} if words else set())


def fingerprint(found: set[str]) -> str:
    return "".join(sorted(found))


def likeness(a: set[str], b: set[str]) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def signature_set(text: str | None) -> np.ndarray:
    """Signatures as sorted numbers, for joins."""
    return np.array(sorted(int(s, 16) for s in signatures(text)), "int64")


def partition_starts(longest: int) -> list[int]:
    """The least length of each partition: lengths of linked sets (5 * least >= 4 * greatest)
    lie in one partition or in two that follow each other."""
    starts = [1]
    while starts[-1] <= longest:
        starts.append(5 * starts[-1] // 4 + 1)
    return starts


def signature_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, node, set) of every row; `node` is a hash of the set, NULL if empty."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sets = [signature_set(t) for t in batch["text"]]
            node = [xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else None for own in sets]
            out = pd.DataFrame({"text_key": batch["text_key"], "doc_id": batch["doc_id"]})
            out["n"] = [len(own) for own in sets]
            signed = [None if x is None else x - (x >> 63 << 64) for x in node]
            out["node"] = pd.array(signed, "Int64")
            out["set"] = sets
            yield out[[*KEY, "n", "node", "set"]]

    schema = "doc_id long, text_key long, n int, node long, set array<long>"
    return keyed(docs).mapInPandas(made, schema)


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(part, signature, node, n, place, home): the rarest signatures of each set, as many as one
    shared by any two linked sets must be among; in its own partition (`home`) and the next."""
    spots = sets.select("node", "n", F.explode("set").alias("signature"))
    seen = spots.groupBy("signature").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    # A signature of one set alone is the rarest there is, but leads nowhere: its place counts.
    alone = F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "signature")
    rows = spots.join(seen, "signature", "left").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(alone)).alias("ordered")  # within one set
    )
    prefix = F.expr("slice(ordered, 1, n - cast(ceil(4 * n / 5) as int) + 1)")
    listed = rows.select("node", "n", F.posexplode(prefix).alias("place", "spot"))
    longest = sets.agg(F.max("n")).first()[0] or 0
    starts = F.lit(partition_starts(longest)).cast("array<int>")  # grows with the logarithm
    own = F.size(F.filter(starts, lambda start: start <= F.col("n")))
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("ahead")
    return (
        listed.filter("spot.seen > 1")
        .select(own.alias("own"), F.col("spot.signature").alias("signature"), "node", "n", "place", both)
        .select(
            (F.col("own") + F.col("ahead")).alias("part"), "signature", "node", "n", "place",
            (F.col("ahead") == 0).alias("home"),
        )
    )


# Two sets of lengths n and m are linked from this many shared signatures on.
NEEDED = "ceil(4 * (n + m) / 9)"
# What they can share if the first signature they share stands in these places.
POSSIBLE = "1 + least(n - place - 1, m - place_b - 1)"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose sets have 100 * intersection >= 80 * union."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - both
    rows = pairs.select("a", "b").join(a, "a").join(b, "b")
    return rows.filter(100 * both >= 80 * union).select("a", "b")


def least_of_lists(lists: DataFrame) -> DataFrame:
    """(a, b): each set with the set that is least at home in most of its lists."""
    least = lists.filter("home").groupBy("part", "signature").agg(F.min("node").alias("b"))
    votes = (
        lists.join(least, ["part", "signature"])
        .filter("node <> b")
        .groupBy(F.col("node").alias("a"), "b")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))


def pruned_pairs(lists: DataFrame, component: DataFrame) -> DataFrame:
    """(a, b) of sets in different components that meet in a list of a partition where b is at
    home, and whose lengths and places allow enough shared signatures."""
    rows = lists.join(if_small(component), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = rows.filter("home").select(
        "part", "signature", F.col("node").alias("b"), F.col("n").alias("m"),
        F.col("place").alias("place_b"), F.col("comp").alias("comp_b"),
    )
    met = rows.withColumnRenamed("node", "a").join(held, ["part", "signature"])
    once = "comp <> comp_b and (not home or a < b)"
    return met.filter(once).filter(f"{POSSIBLE} >= {NEEDED}").select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles (signatures), component_id. Empty sets link with nothing."""
    rows = stage(signature_sets(docs), "signature_sets")
    several = rows.filter("node is not null").select("node", "n", "set")
    sets = stage(several.dropDuplicates(["node"]), "distinct_sets")
    lists = stage(inverted_lists(sets), "signature_lists")
    release(docs.sparkSession)
    found = components(stage(compared(least_of_lists(lists), sets), "links"))
    more = stage(compared(pruned_pairs(lists, found), sets), "links")
    comp = components(found.union(more))
    drop_staged(sets, lists)
    own = rows.join(if_small(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = own.filter("comp is not null").groupBy(F.col("comp").alias("_comp")).agg(
        F.min("doc_id").alias("low")
    )
    return own.join(low, own["comp"] == F.col("_comp"), "left").select(
        *KEY,
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("low", "doc_id").alias("component_id"),
    )


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, context, doc_id, text_key, text) such that rows of a part, sorted, are followed
    by the next document's row; the last one of a part is context only."""
    rows = keyed(docs)
    ids = rows.select("doc_id").filter("doc_id is not null")
    at = ids.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = F.lit(sorted({int(x) for x in at})).cast("array<long>")
    above = F.size(F.filter(bounds, lambda b: b > F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(ranges)).otherwise(above).alias("part")
    rows = rows.select(part, F.lit(0).alias("context"), *KEY, "text")
    heads = (
        rows.groupBy("part").agg(F.max(F.struct(*KEY)).alias("head")).orderBy("part").collect()
    )  # one row per range
    follow = [
        (heads[i - 1]["part"], h["head"]["doc_id"], h["head"]["text_key"])
        for i, h in enumerate(heads)
    ]
    ends = docs.sparkSession.createDataFrame(follow, "to int, _doc_id long, _text_key long")
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    copies = (
        rows.join(F.broadcast(ends), on)
        .groupBy("to", *KEY)
        .agg(F.first("text").alias("text"))
        .select(F.col("to").alias("part"), F.lit(1).alias("context"), *KEY, "text")
    )
    return rows.unionByName(copies)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_signatures."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        with_next(docs, ranges)
        .repartition("part")
        .sortWithinPartitions("part", "context", F.desc_nulls_last("doc_id"), F.desc("text_key"))
    )

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (id, text, signatures) that waits for its next document
        names = [
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next", "n_signatures",
        ]
        for batch in slices(batches):
            out = []
            for context, doc_id, text in zip(
                batch["context"], batch["doc_id"].astype("Int64"), batch["text"], strict=True
            ):
                text = text or ""
                own = signatures(text)
                if last is not None:
                    before_id, before, sig = last
                    n = len(before)
                    half = n // 2
                    edited = before[: n - half] + text[:half]
                    new = signatures(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    near = likeness(sig, new), likeness(sig, own)
                    prints = fingerprint(sig), fingerprint(new)
                    out.append((before_id, n, sha, *prints, *near, len(sig)))
                last = None if context else (doc_id, text, own)
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(
        made,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double, n_signatures long",
    )

"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of five words. Equal sets are one node. With
shingles in one order for all, two sets of Jaccard 0.8 or more share a shingle within their
first |x| - ceil(0.8 |x|) + 1 (the prefix).

1. Prefixes in the order of shingle hashes are joined; what only one node has goes.
2. Estimated cost: shingles that many nodes share are costly. A node with k costly ones in
   its prefix lengthens it by k or more. As |prefix| + k shingles must share k + 1, one of
   those shared is not costly, and the costly ones need not be joined.
3. Each node is verified against the nearest of the least nodes it shares shingles with. A
   group of copies becomes one component by as many checks as it has members.
   Where many components still meet in a shingle (copies edited apart, each near to some of
   the others only), rounds of pivots follow: the least by several hashes, for each node the
   pivot of each hash it shares most shingles with. Texts are read only for pairs whose
   first prefixes, which stand next to the texts, share enough.
4. Pairs that share a prefix shingle but are in different components yet: a pair needs as many
   shared prefix shingles as its sizes and prefixes demand, so it meets in a shingle after which
   both have that many left, itself included. Only shingles that other components have count,
   the rarest first. It must also have parities that few enough shingles can tell apart: each
   shingle of a set turns one bit of `BITS`. What also passes the count of `plausible` is
   compared exactly and linked, so no link between components is missed.

Components are found by rounds of star contractions on edges kept in tables. A shingle is
known by 64 bits, a set by 64 bits.

Lower-cases A-Z; words are runs of other than white space. Fewer than five words are one
shingle; without words (or NULL) the set is empty and links with nothing. Rows with equal sets
are linked whatever their ids; a NULL id is never the least of a component unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casestats.llm.common import (
    BROADCAST_ROWS, KEY, drop_staged, free_name, if_small, keyed, release, slices, stage,
    without_rows,
)

WORDS = 5
# Nodes that may share a shingle before it counts as costly.
COSTLY = 48
# Components that meet in a shingle before pivots are tried; hashes a round; rounds.
MANY, PIVOTS, ROUNDS = 16, 8, 2
# Shingles beyond a prefix that are read ahead, besides two for each costly one.
AHEAD = 32
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
# Bytes in lower case, those that part words, and masks of an integer's lowest bytes.
FOLD = np.frombuffer(bytes(range(256)).lower(), "uint8")
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], "uint64")
# Bytes of a word beyond which it is hashed by itself.
LONG = 64
# Bits of a set's parity.
BITS = 256


def word_hashes(text: str | None) -> np.ndarray:
    """A hash (uint64) of each word, made eight bytes at a time for all words at once."""
    raw = (text or "").encode()
    data = FOLD[np.frombuffer(b" %b%b" % (raw, b" " * 8), "uint8")]
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    out = eight[starts] & LOWEST[np.minimum(lengths, 8)]
    out += lengths.astype("uint64") * MIX[1]
    _mix(out)
    rest, at = np.flatnonzero(lengths > 8), 8
    while len(rest):
        part = eight[starts[rest] + at] & LOWEST[np.minimum(lengths[rest] - at, 8)]
        part ^= out[rest]
        _mix(part)
        out[rest] = part
        at += 8
        if at > LONG:
            for i in rest[lengths[rest] > at]:
                word = data[starts[i] : starts[i] + lengths[i]]
                out[i] = xxhash.xxh3_64_intdigest(word.tobytes())
            break
        rest = rest[lengths[rest] > at]
    return out


def _mix(x: np.ndarray) -> None:
    x ^= x >> np.uint64(32)
    x *= MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    x ^= x >> np.uint64(32)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of the shingles of a text."""
    hashes = word_hashes(text)
    if not len(hashes):
        return np.empty(0, "int64")
    # Fewer words are one shingle, told from longer ones by their number.
    n, width = max(len(hashes) - WORDS + 1, 1), min(len(hashes), WORDS)
    out = hashes[:n] + np.uint64(WORDS - width)
    for i in range(1, width):
        out ^= out >> np.uint64(29)
        out *= MIX[0]
        out += hashes[i : i + n]
    out ^= out >> np.uint64(32)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    out = np.sort(out.view("int64"))
    new = out[1:] != out[:-1]
    return out if new.all() else np.concatenate([out[:1], out[1:][new]])


def parity(own: np.ndarray) -> np.ndarray:
    """For each of `BITS` bits, in longs, whether an odd number of a set's shingles fall on it."""
    odd = np.bincount(own & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype("uint8")).view("int64")


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _prefix_length(n):
    return n - F.ceil(4 * n / 5).cast("int") + 1


def shingled(docs: DataFrame, make_set=shingle_set) -> DataFrame:
    """(doc_id, text_key, n, node, prefix) of every row; node is NULL for an empty set."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 512):
            sizes, nodes, prefixes = [], [], []
            for text in batch["text"]:
                own = make_set(text)
                sizes.append(len(own))
                key = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                nodes.append(key if len(own) else None)
                prefixes.append(own[: prefix_length(len(own))] if len(own) else [])
            out = batch[KEY].copy()
            out["n"], out["prefix"] = sizes, prefixes
            out["node"] = pd.array(nodes, dtype="Int64")
            yield out

    return keyed(docs).mapInPandas(
        made, "doc_id long, text_key long, n int, prefix array<long>, node long"
    )


def shared_shingles(rows: DataFrame) -> DataFrame:
    """(token, node, n) of prefix shingles that two nodes or more have."""
    index = rows.filter(F.col("node").isNotNull()).select(
        F.explode("prefix").alias("token"), "node", "n"
    )
    return index.join(several_nodes(index), "token").distinct()


def several_nodes(index: DataFrame) -> DataFrame:
    """Tokens of two nodes or more."""
    ends = index.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return ends.filter("a < b").select("token")


def costly_tokens(index: DataFrame, costly: int) -> DataFrame:
    counted = index.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
    return counted.filter(F.col("nodes") > costly).select("token")


def lengthened(
    index: DataFrame, texts: DataFrame, costly: int, make_set=shingle_set
) -> DataFrame:
    """`index` with longer prefixes for nodes that have costly shingles in theirs.

    In the order (costly last, hash) a node needs its first |prefix| shingles. It is given
    shingles beyond its prefix, twice as many as the costly ones and `AHEAD` more; shingles
    costly among these are left out as well. A node for which that is too few is given all
    its shingles, until every node has enough. Its first prefix counts in full: what no other
    node has in its first prefix may lie beyond the first prefix of one that was lengthened.
    What a node without costly ones shares with it is within both first prefixes, so those
    stay as they are.
    """
    dear = stage(costly_tokens(index, costly), "costly")
    if dear.isEmpty():
        return index
    touched = (
        index.join(if_small(dear), "token", "left_semi")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("costly"))
    )
    touched = stage(touched, "touched")
    reach = (2 * F.col("costly") + AHEAD).cast("int")
    more = texts.join(if_small(touched), "node").withColumn("reach", reach)
    more = stage(tokens(more, make_set), "longer_prefixes").withColumn("every", F.lit(False))
    first = dear
    own = texts.join(if_small(touched.select("node")), "node", "left_semi")
    own = own.select("node", "n", F.explode("prefix").alias("token"))
    while True:
        dear = stage(dear.union(costly_tokens(more, costly)).distinct(), "costly")
        marker = if_small(dear)
        needed = (
            own.join(marker, "token", "left_semi")
            .groupBy("node")
            .agg(F.countDistinct("token").alias("needed"))
        )
        has = (
            more.filter("not every")
            .join(marker, "token", "left_anti")
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("has"))
        )
        done = more.filter("every").select("node").distinct()
        short = (
            needed.join(has, "node", "left")
            .filter(F.coalesce("has", F.lit(0)) < F.col("needed"))
            .select("node")
            .join(done, "node", "left_anti")
        )
        short = stage(short, "short_prefixes")
        if short.isEmpty():
            break
        every = texts.join(if_small(short), "node").withColumn("reach", F.lit(-1))
        every = tokens(every, make_set).withColumn("every", F.lit(True))
        kept = more.join(if_small(short), "node", "left_anti")
        more = stage(kept.unionByName(every), "longer_prefixes")

    some = more.filter("not every").join(marker, "token", "left_anti")
    marked = more.filter("every").join(
        if_small(dear.withColumn("dear", F.lit(1))), "token", "left"
    )
    order = Window.partitionBy("node").orderBy(F.coalesce("dear", F.lit(0)), "token")
    whole = marked.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= _prefix_length(F.col("n"))
    )
    columns = ["token", "node", "n"]
    rows = (
        index.join(if_small(first), "token", "left_anti")
        .select(columns)
        .unionByName(own.join(marker, "token", "left_anti").select(columns))
        .unionByName(some.select(columns))
        .unionByName(whole.select(columns))
    )
    # Most of what was read ahead no other node has. One shuffle serves all three steps.
    dealt = rows.repartition("token").distinct()
    return dealt.join(several_nodes(dealt), "token")


def tokens(texts: DataFrame, make_set=shingle_set) -> DataFrame:
    """(token, node, n) of (node, text, reach): the `reach` shingles that follow the prefix,
    or all shingles if `reach` is negative."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 64):
            sets, counts = [], []
            for text, reach in zip(batch["text"], batch["reach"], strict=True):
                own = make_set(text)
                at = prefix_length(len(own))
                counts.append(len(own))
                sets.append(own if reach < 0 else own[at : at + reach])
            sizes = np.array([len(x) for x in sets])
            yield pd.DataFrame(
                {
                    "token": np.concatenate(sets),
                    "node": np.repeat(batch["node"].to_numpy("int64"), sizes),
                    "n": np.repeat(np.array(counts, "int32"), sizes),
                }
            )

    return texts.select("node", "text", "reach").mapInPandas(
        made, "token long, node long, n int"
    )


def verified(pairs: DataFrame, texts: DataFrame, make_set=shingle_set) -> DataFrame:
    """The (a, b) of `pairs` whose sets have 100 * intersection >= 80 * union."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_set = None, None
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(
                batch["b"], batch["text_a"], batch["text_b"], strict=True
            ):
                if b != last_key:
                    last_key, last_set = b, make_set(text_b)
                own = make_set(text_a)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                keep.append(100 * both >= 80 * (len(own) + len(last_set) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    near = stage(plausible(pairs, texts), "plausible")
    del pairs
    release(texts.sparkSession)  # shuffles that made the pairs, before texts are shuffled
    return near.join(a, "a").join(b, "b").mapInPandas(kept, "a long, b long")


def needed(n: str, m: str):
    """Shingles that linked sets of sizes n and m share at least."""
    return F.ceil(4 * (F.col(n).cast("long") + F.col(m)) / 9)


def needed_prefix(n: str, m: str):
    """Prefix shingles that linked sets of sizes n and m share at least: those that share s
    of them share at most s + |x| - |prefix| in all."""
    return F.greatest(needed(n, m) - F.ceil(4 * F.greatest(n, m) / 5) + 1, F.lit(1))


def like_parity(n: str, m: str, one: str, other: str):
    """Whether sets of these sizes and parities may be linked: each bit that differs stands for
    a shingle, or more, that only one of the two has."""
    differ = sum(F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(BITS // 64))
    return differ <= F.col(n).cast("long") + F.col(m) - 2 * needed(n, m)


def plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose prefixes in the order of hashes share enough shingles, and
    whose parities allow a link."""
    columns = ["node", "n", "prefix", "bits"]
    a = texts.select(columns).toDF("a", "n", "prefix_a", "bits_a")
    b = texts.select(columns).toDF("b", "m", "prefix_b", "bits_b")
    met = F.size(F.array_intersect("prefix_a", "prefix_b"))
    rows = pairs.select("a", "b").join(a, "a").join(b, "b")
    rows = rows.filter(like_parity("n", "m", "bits_a", "bits_b"))
    return rows.filter(met >= needed_prefix("n", "m")).select("a", "b")


def within_size(a: str, b: str):
    small, large = F.least(a, b), F.greatest(a, b)
    return 5 * small.cast("long") >= 4 * large.cast("long")


def nearest_least(index: DataFrame) -> DataFrame:
    """(a, b): each node with the node that is least for most of its shingles."""
    least = index.groupBy("token").agg(F.min(F.struct("node", "n")).alias("least"))
    votes = (
        index.join(least, "token")
        .select(
            F.col("node").alias("a"), F.col("least.node").alias("b"), "n", F.col("least.n").alias("m")
        )
        .filter((F.col("a") != F.col("b")) & within_size("n", "m"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    return votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))


def with_component(index: DataFrame, component: DataFrame) -> DataFrame:
    return index.join(if_small(component), "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")
    )


def pivot_pairs(index: DataFrame, component: DataFrame, salt: int) -> DataFrame:
    """(a, b): nodes of shingles in which more than `MANY` components meet, each with a pivot
    of another component for each of `PIVOTS` hashes."""
    own = with_component(index, component)
    met = own.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("nodes"))
    crowded = met.groupBy("token").agg(F.count(F.lit(1)).alias("comps")).filter(
        F.col("comps") > MANY
    )
    rows = stage(own.join(crowded.select("token"), "token", "left_semi"), "crowded")
    by_hash = [
        F.min(F.struct(F.xxhash64("node", F.lit(salt + i)), "node", "n", "comp")).alias(f"h{i}")
        for i in range(PIVOTS)
    ]
    pivots = rows.groupBy("token").agg(*by_hash)
    pivots = pivots.select(
        "token", F.posexplode(F.array(*[f"h{i}" for i in range(PIVOTS)])).alias("hash", "p")
    )
    votes = (
        rows.join(pivots, "token")
        .filter((F.col("comp") != F.col("p.comp")) & within_size("n", "p.n"))
        .groupBy(F.col("node").alias("a"), "hash", F.col("p.node").alias("b"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    best = votes.groupBy("a", "hash").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
    return best.select("a", "b").distinct()


def crossing_rows(index: DataFrame, component: DataFrame) -> DataFrame:
    """`index` where components meet, with `rest`: how many of the node's own tokens stand from
    this one on, in one order for all, rarest first."""
    own = with_component(index, component)
    open_tokens = (
        own.groupBy("token")
        .agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("nodes")
        )
        .filter("x < y")
        .select("token", "nodes")
    )
    backwards = Window.partitionBy("node").orderBy(F.desc("nodes"), F.desc("token"))
    rows = own.join(open_tokens, "token").withColumn("rest", F.row_number().over(backwards))
    return rows.drop("nodes")


def met(rows: DataFrame) -> DataFrame:
    """(a, b), once for each token that may be the first that a linked pair of different
    components shares: as many as they need must still follow in both, and parities, where `rows` has
    them, must allow a link."""
    names = {"node": "b", "n": "m", "comp": "comp_b", "rest": "rest_b", "bits": "bits_b"}
    other = rows.select("token", *[F.col(c).alias(b) for c, b in names.items() if c in rows.columns])
    linkable = (
        (F.col("node") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & within_size("n", "m")
        & (F.least("rest", "rest_b") >= needed_prefix("n", "m"))
    )
    if "bits" in rows.columns:
        linkable &= like_parity("n", "m", "bits", "bits_b")
    return rows.join(other, "token").filter(linkable).select(F.col("node").alias("a"), "b")


def crossing_pairs(index: DataFrame, component: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of nodes in different components that may share enough shingles."""
    rows = crossing_rows(index, component).join(texts.select("node", "bits"), "node")
    return met(stage(rows, "crossing")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node that links, a pair a row, lead to, for every node with a
    link.

    Large and small stars by turns; every round is written, and edges get fewer and shorter
    until each node points at its least one.
    """
    edges = stage(links.toDF("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a != b").distinct()
        # Small star: every node points at its smaller neighbours now.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(least.select("a", F.col("low").alias("b"))).filter("a != b").distinct()
        edges = stage(small, "edges")
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")
        ).first()
        if now == before and now[0] == now[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = now


def near_duplicates(docs: DataFrame, costly: int = COSTLY, make_set=shingle_set) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    with_prefix = stage(shingled(docs, make_set), "shingled")
    rows = stage(with_prefix.select(*KEY, "n", "node"), "nodes")
    shared = stage(shared_shingles(with_prefix), "shared_shingles")
    release(spark)
    # One text of each node that shares a shingle; equal sets give equal shingles.
    chosen = stage(chosen_rows(rows, shared.select("node").distinct()), "chosen_rows")
    texts = stage(texts_of(docs, chosen, make_set), "node_texts")
    drop_staged(with_prefix)
    release(spark)
    index = stage(lengthened(shared, texts, costly, make_set), "prefixes")
    drop_staged(shared)
    release(spark)

    comp = components(stage(verified(nearest_least(index), texts, make_set), "links"))
    for turn in range(ROUNDS):
        release(spark)
        more = stage(verified(pivot_pairs(index, comp, turn * PIVOTS), texts, make_set), "links")
        if more.isEmpty():
            break
        comp = components(comp.union(more))
    release(spark)
    more = stage(verified(crossing_pairs(index, comp, texts), texts, make_set), "links")
    comp = components(comp.union(more))
    drop_staged(texts, index)
    release(spark)

    own = rows.join(if_small(comp), "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")
    )
    low = (
        own.filter(F.col("comp").isNotNull())
        .groupBy(F.col("comp").alias("_comp"))
        .agg(F.min("doc_id").alias("low"))
    )
    return own.join(low, own["comp"] == F.col("_comp"), "left").select(
        *KEY,
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("low", "doc_id").alias("component_id"),
    )


def texts_of(source: DataFrame, chosen: DataFrame, make_set=shingle_set) -> DataFrame:
    """(node, text, n, prefix, bits): the text of each node's chosen row, known by id and text key.

    Only of a row that stands several times are texts shuffled, once combined within tasks.
    """
    names = {"doc_id": "_id", "text_key": "_key", "node": "node", "copies": "copies"}
    chosen = chosen.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))

    def found(rows):
        return keyed(source).join(if_small(rows), same).select("node", "text")

    once = found(chosen.filter("copies = 1"))
    often = found(chosen.filter("copies > 1")).dropDuplicates(["node"])

    def with_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sets = [make_set(t) for t in batch["text"]]
            out = batch[["node", "text"]].copy()
            out["n"] = np.array([len(own) for own in sets], "int32")
            out["prefix"] = [own[: prefix_length(len(own))] for own in sets]
            out["bits"] = [parity(own) for own in sets]
            yield out

    schema = "node long, text string, n int, prefix array<long>, bits array<long>"
    return once.unionByName(often).mapInPandas(with_set, schema)


def chosen_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, doc_id, text_key, copies): the least row of each wanted node, and how many rows
    are equal to it."""
    held = rows.select("node", *KEY).join(wanted, "node", "left_semi")
    counted = held.groupBy("node", *KEY).agg(F.count(F.lit(1)).alias("copies"))
    least = counted.groupBy("node").agg(F.min(F.struct(*KEY, "copies")).alias("least"))
    return least.select("node", "least.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the least id. A NULL id alone in its component
    stays; of repeated rows one stays."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without_rows(docs, near_duplicates(docs).filter(first), "left_semi")
    text_key = free_name(docs, "_text_key")
    return (
        kept.withColumn(text_key, F.xxhash64("text"))
        .dropDuplicates(["doc_id", text_key])
        .drop(text_key)
    )


__all__ = ["BROADCAST_ROWS", "components", "keep_one", "near_duplicates", "shingle_set"]

"""Suffix-array dedup: bytes covered by a string of 400 that starts anywhere else as well.

1. Anchors. Every string of `SPAN` bytes holds one anchor at least, its least hashed k-gram
   (first of equals), and equal strings hold it at the same place. Only k-grams that are an
   anchor twice go on, each with its context: the bytes that a string around it can have.
2. Equal contexts are one, with a count: more than one covers the whole context.
3. Different contexts of one anchor are gathered in bounded collections, and a collection's
   Burrows-Wheeler transform is built column by column: contexts stand aligned at the anchor,
   and each round, from the right, inserts one symbol of every context. The order of all
   suffixes and their common prefixes with their neighbours are updated by a stable pass over
   the previous round's. A suffix whose common prefix with a neighbour reaches 400 is a string
   that starts elsewhere too. Collections are dealt by anchor and read one after the other,
   so no table of all suffixes exists anywhere.
4. An anchor with very many different contexts is refined instead: blocks of start positions
   are split while only the part common to the block repeats, down to single strings. These are
   counts that combine before the shuffle, whatever the size of the group.

A position inside a periodic stretch is an anchor as often as the period says; a document
settles contexts that repeat inside it by itself and hands on one of each.

NULL counts as empty. Texts of fewer than 400 bytes lose nothing. Repeated rows are documents
of their own, so both lose what they share. Bytes are removed wherever they stand, also inside
characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casestats.llm.common import KEY, join_keyed, keyed, slices, stage

SPAN = 400
GRAM = 48
# Contexts in a collection, and of one anchor before it is refined.
COLLECTION = 4_000
MOST_CONTEXTS = 20_000
# Sizes of blocks of start positions when refining.
BLOCKS = (32, 4, 1)
FACTOR = 0x9E3779B97F4A7C15
_PLACE_BITS = 28

_powers = {"up": np.empty(0, "uint64"), "down": np.empty(0, "uint64")}


def _power(name: str, n: int) -> np.ndarray:
    if n > len(_powers[name]):
        factor = FACTOR if name == "up" else pow(FACTOR, -1, 1 << 64)
        out = np.full(2 * n, factor, "uint64")
        out[0] = 1
        _powers[name] = np.cumprod(out)
    return _powers[name][:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo("uint64").max, "uint64")
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the anchors of a text."""
    n = len(data)
    if n < span:
        return np.empty(0, "int64"), np.empty(0, "uint64")
    symbols = np.frombuffer(data, "uint8").astype("uint64") + np.uint64(1)
    sums = np.zeros(n + 1, "uint64")
    np.cumsum(symbols * _power("down", n), out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _power("up", n - gram + 1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keyed_by_place = (h & ~low) | (np.arange(len(h), dtype="uint64") & low)
    least = _sliding_least(keyed_by_place, span - gram + 1)
    changed = np.flatnonzero(np.diff(least, prepend=least[0] + np.uint64(1)))
    # The chosen place lies in the window, whose start gives what the kept bits leave out.
    at = (least[changed] - changed.astype("uint64")) & low
    at = np.unique(changed + at.astype("int64"))
    return at, h[at]


def _context(data: bytes, at: int, span: int, gram: int) -> tuple[int, int]:
    """First byte and end of what strings around an anchor can cover."""
    return max(0, at - (span - gram)), min(len(data), at + span)


def anchored(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """Per row: n_bytes, spans found inside it, and its anchors as arrays."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for text in batch["text"]:
                data = (text or "").encode()
                at, grams = anchors(data, span, gram)
                seen: dict[tuple[int, int], list[int]] = {}
                for place, h in zip(at.tolist(), grams.view("int64").tolist(), strict=True):
                    lo, hi = _context(data, place, span, gram)
                    ctx = xxhash.xxh3_64_intdigest(data[lo:hi], place - lo) - (1 << 63)
                    seen.setdefault((h, ctx), []).append(place)
                own = [
                    _context(data, place, span, gram)
                    for places in seen.values()
                    if len(places) > 1
                    for place in places
                ]
                rows.append(
                    (
                        len(data),
                        [x for s in merged(own) for x in s],
                        [h for h, _ in seen],
                        [c for _, c in seen],
                        [places[0] for places in seen.values()],
                        [min(len(places), 2) for places in seen.values()],
                    )
                )
            names = ["n_bytes", "own", "gram", "ctx", "at", "times"]
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[KEY], out], axis=1)

    schema = (
        "doc_id long, text_key long, n_bytes long, own array<long>, gram array<long>, "
        "ctx array<long>, at array<long>, times array<int>"
    )
    return keyed(docs).mapInPandas(made, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one; in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def repeated_suffixes(strings: list[bytes], ahead: list[int], width: int, span: int) -> np.ndarray:
    """Which strings of `span` symbols repeat in a collection of aligned contexts.

    strings[i] begins `ahead[i]` columns before the anchor's column `width`. Returns a
    table (context, start column) of booleans. Every round inserts one symbol per context,
    right to left, and keeps the order of the suffixes and the common prefix of each with
    the one before it.
    """
    n, columns = len(strings), width + span
    table = np.zeros((columns, n), "int16")  # 0: no symbol here
    for i, (s, a) in enumerate(zip(strings, ahead, strict=True)):
        table[width - a : width - a + len(s), i] = np.frombuffer(s, "uint8").astype("int16") + 1
    out = np.zeros((n, width + 1), bool)
    order = np.arange(n)
    common = np.zeros(n, "int32")  # with the suffix before; 0 for the first
    for column in range(columns - 1, -1, -1):
        symbols = table[column][order]
        moved = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[moved]
        same = np.flatnonzero(
            (sorted_symbols[1:] == sorted_symbols[:-1]) & (sorted_symbols[1:] > 0)
        )
        fresh = np.zeros(n, "int32")
        if len(same):
            fresh[same + 1] = 1 + _range_least(common, moved[same] + 1, moved[same + 1])
        order, common = order[moved], fresh
        if column <= width:
            long = common >= span
            long[:-1] |= common[1:] >= span
            out[order, column] = long
    return out


def _range_least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo..hi], ends included."""
    if (lo == hi).all():
        return x[lo]
    levels, width, longest = [x], 1, int((hi - lo).max()) + 1
    while 2 * width <= longest:
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), x.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
    return out


def runs(flags: np.ndarray) -> list[int]:
    """First and last place of every run of True, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("int8"), [0]])))
    edges[1::2] -= 1
    return edges.tolist()


def compared(contexts: DataFrame, collections: int, span: int, gram: int) -> DataFrame:
    """(gram, ctx, starts): runs of start columns whose string repeats among the contexts."""
    width = span - gram

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_suffixes(list(pdf["data"]), list(pdf["ahead"]), width, span)
        return pd.DataFrame(
            {"gram": pdf["gram"], "ctx": pdf["ctx"], "starts": [runs(f) for f in found]}
        )

    collection = F.pmod(F.xxhash64("gram"), F.lit(collections))
    return (
        contexts.withColumn("collection", collection)
        .groupBy("collection")
        .applyInPandas(built, "gram long, ctx long, starts array<long>")
    )


def refined(contexts: DataFrame, span: int, gram: int) -> DataFrame:
    """The same as `compared` for anchors with any number of contexts."""
    width = span - gram
    blocks = contexts.select("gram", "ctx", F.array(F.lit(0)).cast("array<long>").alias("open"))
    step, found = width + 1, []
    for size in BLOCKS:

        def split(batches: Iterator[pd.DataFrame], size=size, step=step) -> Iterator[pd.DataFrame]:
            for batch in slices(batches):
                rows = []
                for g, c, data, ahead, blocks in zip(
                    batch["gram"], batch["ctx"], batch["data"], batch["ahead"], batch["open"],
                    strict=True,
                ):
                    # Start columns first..last can be strings of this context.
                    first, last = width - ahead, width - ahead + len(data) - span
                    for block in blocks:
                        for lo in range(block, min(block + step, width + 1), size):
                            hi = min(lo + size, block + step, width + 1) - 1
                            if hi < first or lo > last:
                                continue
                            whole = first <= lo and hi <= last
                            a, b = lo - first, hi - first
                            core = xxhash.xxh3_64_intdigest(data[b : a + span])
                            full = xxhash.xxh3_64_intdigest(data[a : b + span]) if whole else 0
                            rows.append((g, c, lo, hi, whole, core - (1 << 63), full - (1 << 63)))
                yield pd.DataFrame(
                    rows, columns=["gram", "ctx", "lo", "hi", "whole", "core", "full"]
                )

        schema = "gram long, ctx long, lo long, hi long, whole boolean, core long, full long"
        rows = stage(
            contexts.join(blocks, ["gram", "ctx"]).mapInPandas(split, schema), "suffix_blocks"
        )
        # What all strings of a block have in common is there even if some of them are not.
        # A block goes on if its common part is found in blocks that differ.
        mark = F.when(F.col("whole"), F.col("full")).otherwise(F.col("ctx"))
        cores = (
            rows.groupBy("gram", "lo", "core")
            .agg(F.min(mark).alias("a"), F.max(mark).alias("b"))
            .filter("a < b")
            .select("gram", "lo", "core", F.lit(True).alias("differs"))
        )
        fulls = (
            rows.filter("whole")
            .groupBy("gram", "lo", "full")
            .agg(F.count(F.lit(1)).alias("c"), F.min("ctx").alias("one"))
            .filter("c > 1")
            .select("gram", "lo", "full", "one")
        )
        marked = rows.join(cores, ["gram", "lo", "core"], "left").join(
            fulls, ["gram", "lo", "full"], "left"
        )
        again = F.col("whole") & F.col("one").isNotNull()
        # Of equal blocks, which are settled, one goes on for others to be compared with.
        still = F.coalesce("differs", F.lit(False)) & (~again | (F.col("ctx") == F.col("one")))
        marked = marked.select(
            "gram", "ctx", "lo", "hi", again.alias("again"), still.alias("still")
        )
        marked = stage(marked, "suffix_blocks")
        found.append(marked.filter("again").select("gram", "ctx", "lo", "hi"))
        blocks = (
            marked.filter("still")
            .groupBy("gram", "ctx")
            .agg(F.collect_list("lo").alias("open"))
        )
        step = size
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("gram", "ctx").agg(
        F.flatten(F.collect_list(F.array("lo", "hi"))).alias("starts")
    )


def contexts_of(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """(gram, ctx, ahead, data, many) of the wanted (gram, ctx, doc key, at, many)."""
    per_doc = wanted.groupBy(*KEY).agg(
        F.collect_list(F.struct("gram", "ctx", "at", "many")).alias("places")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for text, places in zip(batch["text"], batch["places"], strict=True):
                data = (text or "").encode()
                for p in places:
                    lo, hi = _context(data, p["at"], span, gram)
                    rows.append((p["gram"], p["ctx"], p["at"] - lo, data[lo:hi], p["many"]))
            yield pd.DataFrame(rows, columns=["gram", "ctx", "ahead", "data", "many"])

    # Repeated rows have equal texts: one of them is enough.
    rows = join_keyed(keyed(docs), per_doc, "inner").drop(*KEY)
    schema = "gram long, ctx long, ahead long, data binary, many boolean"
    return rows.mapInPandas(cut, schema).dropDuplicates(["gram", "ctx"])


def repeated_spans(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """doc_id, text_key, n_bytes, spans: [first, end) pairs of removed bytes, flattened."""
    rows = stage(anchored(docs, span, gram), "anchors")
    places = rows.select(
        *KEY,
        "n_bytes",
        F.explode(F.arrays_zip("gram", "ctx", "at", "times")).alias("p"),
    ).select(*KEY, "n_bytes", "p.*")
    again = (
        places.groupBy("gram")
        .agg(F.sum("times").alias("c"))
        .filter("c > 1")
        .select("gram")
    )
    places = stage(places.join(again, "gram"), "repeated_anchors")
    ctx = places.groupBy("gram", "ctx").agg(
        F.sum("times").alias("times"), F.min(F.struct(*KEY, "at")).alias("first")
    )
    ctx = stage(ctx, "contexts")
    variety = ctx.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    wanted = ctx.join(variety, "gram").select(
        "gram", "ctx", "first.*", (F.col("contexts") > most_contexts).alias("many")
    )
    contexts = stage(contexts_of(docs, wanted, span, gram), "context_bytes")
    few = contexts.filter("not many")
    n = few.count()
    found = compared(few, max(1, -(-n // COLLECTION)), span, gram)
    many = contexts.filter("many").drop("many")
    if not many.isEmpty():
        found = found.unionByName(refined(many, span, gram))
    found = stage(found.filter(F.size("starts") > 0), "repeated_starts")

    width = span - gram
    whole = F.array(
        F.greatest(F.col("at") - width, F.lit(0)), F.least(F.col("at") + span, "n_bytes")
    )
    pairs = F.sequence(F.lit(0), F.size("starts") - 2, F.lit(2))
    parts = F.flatten(
        F.transform(
            pairs,
            lambda i: F.array(
                F.col("at") - width + F.get("starts", i),
                F.col("at") - width + F.get("starts", i + 1) + span,
            ),
        )
    )
    copies = ctx.filter("times > 1").select("gram", "ctx", F.lit(True).alias("copied"))
    spans = F.when(F.col("copied"), whole).otherwise(parts)
    covered = (
        places.join(copies, ["gram", "ctx"], "left")
        .join(found, ["gram", "ctx"], "left")
        .filter("copied or starts is not null")
        .select(*KEY, spans.alias("s"))
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list("s")).alias("spans"))
    )
    own = rows.select(*KEY, "n_bytes", "own")
    return join_keyed(own, covered, "left").select(
        *KEY,
        "n_bytes",
        F.concat("own", F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, most_contexts: int = MOST_CONTEXTS
) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    spans = repeated_spans(docs, span, gram, most_contexts).filter(F.size("spans") > 0)
    rows = join_keyed(keyed(docs), spans.drop("n_bytes").distinct(), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for text, flat in zip(batch["text"], batch["spans"], strict=True):
                data, at, kept = (text or "").encode(), 0, []
                flat = [] if flat is None else flat
                gone = merged([(int(a), int(b)) for a, b in zip(flat[::2], flat[1::2], strict=True)])
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                rest = b"".join([*kept, data[at:]])
                out.append(
                    (len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest)
                )
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pd.concat(
                [batch[KEY], pd.DataFrame(out, columns=names, index=batch.index)], axis=1
            )

    schema = (
        "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, kept binary"
    )
    return rows.mapInPandas(cut, schema)

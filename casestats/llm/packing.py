"""Mixture-controlled packing of token ids into sequences of one length.

Every source is a queue of its documents. Queues are served by deficit round-robin: in each
round a queue is given credit for its share of a window, sends the packets its credit covers,
and keeps the rest for later rounds. A document is cut into packets of at most `packet`
tokens, so none holds a window for itself. The stream of packets is cut into sequences of
`length` tokens; what is left at the end is cut into sequences of powers of two, so no
sequence is padded.

A queue that always has packets has been given r times its quantum by the end of round r,
whatever happened before. So a packet goes out in the first round whose credit reaches the
queue's tokens up to its end, and rounds need no loop: prefix sums carry a queue's credit from
one partition to the next, and the place in the stream is one over rounds. Both are taken
within bounded groups (a task's own rows, a band of rounds) and then over the groups' sums.

By default a queue's target is its share of all tokens, so all queues end together. With other
targets, those that are left share the windows once a queue is empty.

A NULL text is empty: its document is the closing id alone. A NULL source is a queue of its
own. Repeated rows are packed each. An empty table gives no rows. Only id, text and source are
read, so other columns can't clash. A task holds one text's ids at a time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casestats.llm.bpe import PLAIN, _byte_letters
from casestats.llm.common import stage

LENGTH, PACKET, END = 4096, 512, 2

# Credit is counted in parts of a token, so that small shares are met too.
UNITS = 1 << 16
# Rounds whose packets are ordered together, and bands whose sums are.
BAND, BANDS = 256, 4096

# Words that a worker remembers, and their greatest size.
WORDS, WORD_SIZE = 500_000, 48

# Stands for the end of a word; texts of `PLAIN` characters have none.
WORD_END = "\0"
# Words as the vocabulary cuts them, in texts of these characters alone and in lower case.
CUT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-ÿ]+")

# Fixed value: how the vocabulary cuts words. White space is dropped, so what stands on either
# side of it is encoded apart.
DROPS_WHITE_SPACE = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}

PACKETS = (
    "packet long, part int, doc_id long, source string, start long, size long, "
    "doc_tokens long, sent long, ids binary"
)
PIECES = (
    "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, round long"
)


class Words(dict):
    """Ids (little-endian, of `dtype`) by word, encoded when first met.

    `merges` says that the vocabulary's merges are settled, see `settled`.
    """

    def __init__(self, vocabulary: str, merges: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(vocabulary)
        self.apart = words_apart(said)
        self.special = [t["content"] for t in said["added_tokens"]]
        self.merger = _merger(said) if merges and self.apart else None
        greatest = max(self.tokenizer.get_vocab_size(), END + 1)
        self.dtype, self.code = ("<u2", "H") if greatest <= 1 << 16 else ("<u4", "I")

    def __missing__(self, word: str | bytes) -> bytes:
        """A word as the vocabulary cuts it, or in bytes whatever stands between white space."""
        if isinstance(word, str):
            ids = self.merger.encode_ordinary(word + WORD_END)
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        found = array(self.code, ids).tobytes()
        if len(word) <= WORD_SIZE:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not self.apart:
            words = [text.encode()]
        elif self.merger and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            words = CUT.findall(text.lower())
        else:
            words = text.encode().split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), self.dtype)


def words_apart(said: dict) -> bool:
    """Whether words between ASCII white space are encoded each for itself."""
    cuts = said["pre_tokenizer"] or {}
    normal = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
    return (
        cuts.get("type") == "Sequence"
        and cuts["pretokenizers"][0] == DROPS_WHITE_SPACE
        and cuts["pretokenizers"][1]["type"] == "ByteLevel"
        and not cuts["pretokenizers"][1]["add_prefix_space"]
        and normal == ["NFC", "Replace", "Lowercase"]
        and not said["post_processor"]
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]
        )
    )


def settled(said: dict) -> bool:
    """Whether merging any neighbours that make a token, lowest id first, gives what the listed
    merges give.

    It does if merges stand in the order of their ids and each token, cut into letters and
    merged by itself, becomes one token: two parts of a token that meet have then been merged
    as they are in the token alone, so they are the listed pair.
    """
    model = said["model"]
    end, ids = model.get("end_of_word_suffix"), model["vocab"]
    if model["type"] != "BPE" or not end or model.get("ignore_merges") or model.get("dropout"):
        return False
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: n for n, pair in enumerate(merges)}
    at = [ids["".join(pair)] for pair in merges]
    letters = [t for t in ids if len(t.removesuffix(end)) <= 1]
    if at != sorted(set(at)) or max((ids[t] for t in letters), default=0) >= at[0]:
        return False
    never = len(merges)
    for pair in merges:
        token = "".join(pair)
        parts = list(token.removesuffix(end))
        if token.endswith(end):
            parts[-1] += end
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), never))
            if (parts[best], parts[best + 1]) not in rank:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return True


def _merger(said: dict):
    """The vocabulary for a library that merges by id alone: a word's end is a character that
    no word has, and takes part in the first merge."""
    import tiktoken

    end = said["model"]["end_of_word_suffix"]
    back = {c: b for b, c in _byte_letters().items()}
    ranks = {
        bytes(back[c] for c in t.removesuffix(end)) + WORD_END.encode() * t.endswith(end): i
        for t, i in said["model"]["vocab"].items()
    }
    pattern = f"[^{WORD_END}]+{WORD_END}"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_words: dict[int, Words] = {}
_settled: dict[int, bool] = {}


def words_of(vocabulary: str, merges: bool) -> Words:
    """One per worker and vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _words:
        _words.clear()
        _words[key] = Words(vocabulary, merges)
    return _words[key]


def read_vocabulary(file: str) -> tuple[str, bool]:
    """A vocabulary file's text, and whether its merges are settled (looked at on the driver,
    once)."""
    text = Path(file).read_text(encoding="utf-8")
    key = zlib.crc32(text.encode())
    if key not in _settled:
        _settled[key] = settled(json.loads(text))
    return text, _settled[key]


def packets(
    docs: DataFrame, vocabulary_file: str, source: Column, packet: int = PACKET, end: int = END
) -> DataFrame:
    """Each document's ids and the closing one in packets. `sent` counts the tokens of the
    packet's source earlier in the same part."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_file))
    schema = pa.schema(
        [
            ("packet", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()),
            ("source", pa.string()), ("start", pa.int64()), ("size", pa.int64()),
            ("doc_tokens", pa.int64()), ("sent", pa.int64()), ("ids", pa.binary()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = words_of(*vocabulary.value), TaskContext.get().partitionId()
        number, sent = part << 33, Counter()
        rows, held = [], 0
        for batch in batches:
            columns = (batch[c] for c in ("doc_id", "source", "text"))
            for doc_id, name, text in zip(*columns, strict=True):
                name = name.as_py()
                ids = np.append(own.ids(text.as_py() or ""), np.array(end, own.dtype))
                for start in range(0, len(ids), packet):
                    some = ids[start : start + packet]
                    rows.append(
                        (number, part, doc_id.as_py(), name, start, len(some), len(ids),
                         sent[name], some.tobytes())
                    )
                    number += 1
                    sent[name] += len(some)
                    held += len(some)
                    if held > 1_000_000:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        yield _batch(rows, schema)

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), "text"
    )
    return named.mapInArrow(cut, PACKETS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def credits(cut: DataFrame, targets: DataFrame | None, length: int) -> DataFrame:
    """(part, source, before, quantum): tokens of the source in earlier parts, and its credit
    a round. `targets` gives (source, target) for every source."""
    sizes = stage(cut.groupBy("part", "source").agg(F.sum("size").alias("tokens")), "part_sizes")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = sizes.groupBy("source").agg(F.sum("tokens").cast("double").alias("target"))
    if targets is not None:
        wanted = targets.select(
            F.col("source").alias("_source"), F.col("target").cast("double").alias("wanted")
        )
        named = totals.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left")
        given = F.col("wanted") > 0
        name = F.coalesce("source", F.lit("NULL"))
        refused = F.raise_error(F.concat(F.lit("no target for "), name)).cast("double")
        totals = named.select("source", F.when(given, F.col("wanted")).otherwise(refused).alias("target"))
    whole = totals.agg(F.sum("target").alias("target")).scalar()
    quantum = F.floor(F.col("target") / whole * (length * UNITS)).cast("long")
    shares = totals.select(
        F.col("source").alias("_source"), F.greatest(quantum, F.lit(1)).alias("quantum")
    )
    return (
        sizes.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .join(shares, F.col("source").eqNullSafe(F.col("_source")))
        .select("part", F.col("source").alias("queue"), "before", "quantum")
    )


def scheduled(cut: DataFrame, targets: DataFrame | None, length: int) -> DataFrame:
    """The packets with their `round`, `done` (the source's tokens up to their end) and
    `place`, the number of tokens before them in the stream."""
    credit = stage(credits(cut, targets, length), "credits").withColumnRenamed("part", "_part")
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("queue"))
    done = F.col("before") + F.col("sent") + F.col("size")
    turn = F.expr(f"(done * {UNITS} + quantum - 1) div quantum")
    served = (
        cut.join(credit, same)
        .withColumn("done", done)
        .withColumn("round", turn)
        .drop("_part", "queue", "before", "quantum", "sent")
        .withColumn("band", F.expr(f"round div {BAND}"))
    )
    bands = stage(served.groupBy("band").agg(F.sum("size").alias("tokens")), "bands")
    earlier = Window.partitionBy("_block").orderBy("band").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bands = bands.withColumn("_block", F.expr(f"band div {BANDS}"))
    blocks = bands.groupBy("_block").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("block_start")
    )
    starts = bands.withColumn(
        "within", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
    ).join(blocks, "_block")
    starts = starts.select(
        F.col("band").alias("_band"), (F.col("block_start") + F.col("within")).alias("band_start")
    )
    order = Window.partitionBy("band").orderBy("round", "source", "done").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        served.withColumn("within", F.sum("size").over(order) - F.col("size"))
        .join(starts, F.col("band") == F.col("_band"))
        .withColumn("place", F.col("band_start") + F.col("within"))
        .drop("band", "_band", "band_start", "within")
    )


def borders(total: int, length: int) -> list[int]:
    """Where the sequences of the end begin: after the full ones, powers of two."""
    out, at = [], total - total % length
    for power in reversed(range((length - 1).bit_length())):
        if total % length & 1 << power:
            out.append(at)
            at += 1 << power
    return out


def pack(
    docs: DataFrame,
    vocabulary_file: str,
    source: Column,
    targets: DataFrame | None = None,
    length: int = LENGTH,
    packet: int = PACKET,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece, see `PIECES`; with `with_ids` also its ids (uint32, little-endian)."""
    cut = stage(packets(docs, vocabulary_file, source, packet), "packets")
    total = cut.agg(F.sum("size")).first()[0] or 0
    last = borders(total, length)
    full = total // length
    dtype = words_of(*read_vocabulary(vocabulary_file)).dtype

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [*last[1:], total]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype).astype("<u4")
                at = 0
                while at < len(ids):
                    place = row["place"] + at
                    number, offset = divmod(place, length)
                    room = length - offset
                    if number >= full:
                        k = next(k for k, end in enumerate(ends) if place < end)
                        number, offset, room = full + k, place - last[k], ends[k] - place
                    some = ids[at : at + room].tobytes()
                    piece = (
                        row["doc_id"], row["source"], row["start"] + at, len(some) // 4,
                        zlib.crc32(some), row["doc_tokens"], number, offset, row["round"],
                    )
                    out.append(piece + (some,) if with_ids else piece)
                    at += room
            if out:
                columns = [pa.array(list(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(t) for c, t in zip(columns, types, strict=True)], names=names
                )

    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return (
        scheduled(cut, targets, length)
        .select("doc_id", "source", "start", "doc_tokens", "round", "place", "ids")
        .mapInArrow(pieces, schema)
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, docs): the packed ids of each sequence and which document
    stands where in it, from pieces with their ids. A sequence is the whole of a group."""
    part = F.struct("offset", "length", "doc_id", "start", "ids")
    listed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return listed.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        ids.alias("ids"),
        F.transform(
            "parts",
            lambda p: F.struct(
                p["doc_id"].alias("doc_id"), p["start"].alias("start"),
                p["offset"].alias("offset"), p["length"].alias("length"),
            ),
        ).alias("docs"),
    )

"""Training-order materialisation of token ids.

Ids of any vocabulary, of a fixed number of bytes each, are written by `write_ids`; `bpe_ids`
makes those of a byte-level BPE vocabulary, `byte_ids` the UTF-8 bytes of a text. Texts, each
with its ids and END, stand in the order of (a hash of id and text, doc_id, text); the order is
found by one shuffle to uniform ranges of the hash and doesn't depend on how many there are.
The stream of all ids is cut into sequences of `length` ids, so only the last one is filled with
PAD. With `apart` every text starts a sequence of its own and fills its last one instead.

Sequences have dense numbers; a keyed Feistel network with cycle-walking maps number to slot, a
permutation of 0..N-1. Shard `slot // per_shard` is one file of raw bytes in which row
`slot % per_shard` starts at that many times the stride: a reader seeks to any slot and reads on.
Ranges of shards are tasks; a task writes its files under a name of its own and renames them
when they are whole, so a task that is repeated leaves the same files. Beside them lie a manifest
and an index of the pieces of texts, by which `rewrite_shards` makes lost shards again without
numbering anything anew. The same rows and key give the same files. The manifest is written last:
what was cut off has none, and can't be read.

NULL texts count as empty: one piece that holds END alone. Repeated rows get places of their own
(rows of one id and text meet in one range). An empty table writes no shard. A text's ids are one
value, so a text must fit in a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casestats.llm import bpe
from casestats.llm.common import KEY, keyed, new_path, release, slices
from casestats.sources.staging import delete

# Bytes that UTF-8 never uses.
END, PAD = 0xFF, 0xFE
LENGTH = 2048
PER_SHARD = 8192
ORDER_KEY = 20_240_229
ROUNDS = 6
# Tasks that write shards; beyond that a task writes more than one.
MOST_TASKS = 20_000
# Rows that are read or cut at a time.
AT_ONCE = 256
# Shards are written in so many turns, so that only one turn's pieces lie in a shuffle at a time.
TURNS = 2

INDEX = (
    "slot long, shard long, row int, offset int, doc_id long, text_key long, part int, "
    "start long, n_ids int"
)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int = ORDER_KEY) -> np.ndarray:
    """Slot of each number: a bijection of 0..n-1 chosen by `key`."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype="uint64"), key % (1 << 64))

    def once(x):
        left, right = x >> width, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, int(k)) & mask)
        return (left << width) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype("uint64"))
        while (outside := out >= np.uint64(n)).any():  # walk the cycle back into 0..n-1
            out[outside] = once(out[outside])
    return out.astype("int64")


def byte_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, ids): UTF-8 bytes and END."""
    data = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(bytes([END])))
    return keyed(docs).select("doc_id", "text_key", data.alias("ids"))


def bpe_ids(docs: DataFrame, vocabulary_file: str) -> tuple[DataFrame, int, int, int]:
    """(doc_id, text_key, ids) in a vocabulary, bytes an id (2 or 4, little-endian), END and
    PAD: the two ids after the greatest one of the vocabulary."""
    said = json.loads(Path(vocabulary_file).read_text())
    known = [*said["model"]["vocab"].values(), *(t["id"] for t in said["added_tokens"])]
    end, pad = max(known) + 1, max(known) + 2
    width = 2 if pad < 1 << 16 else 4

    vocabulary = docs.sparkSession.sparkContext.broadcast(json.dumps(said))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = bpe.coder(vocabulary.value)
        for batch in slices(batches):
            out = batch[["doc_id", "text_key"]].copy()
            # Whole texts: without a search for repeated chunks, which costs more than it saves here.
            ids = (np.append(np.frombuffer(own.encode(t or ""), "<u4"), end) for t in batch["text"])
            out["ids"] = [x.astype(f"<u{width}").tobytes() for x in ids]
            yield out

    ids = keyed(docs).mapInPandas(packed, "doc_id long, text_key long, ids binary")
    return ids, width, end, pad


def in_order(ids: DataFrame, width: int, length: int, apart: bool) -> DataFrame:
    """Rows with their range and the ids before them in it (`before`), `span` ids each."""
    spark = ids.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64("doc_id", "text_key")
    # The upper 31 bits of the hash, as an unsigned number, cut evenly.
    range_of = F.shiftright(F.shiftrightunsigned(place, 33) * F.lit(ranges), 31).cast("int")
    rows = ids.select(place.alias("place"), range_of.alias("range"), *KEY, "ids")
    rows = rows.repartitionById(ranges, F.col("range"))
    # Negative hashes have the greater upper bits.
    order = ["range", F.col("place") < 0, "place", *KEY]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun = 0, {}
        for batch in batches:
            span = pc.binary_length(batch["ids"]).to_numpy().astype("int64") // width
            if apart:
                span = -(-span // length) * length
            starts = at + np.cumsum(span) - span
            at += int(span.sum())
            ranges, first, which = np.unique(
                batch["range"].to_numpy(), return_index=True, return_inverse=True
            )
            for r, i in zip(ranges.tolist(), first.tolist(), strict=True):
                begun.setdefault(r, starts[i])
            before = starts - np.array([begun[r] for r in ranges.tolist()], "int64")[which]
            columns = [batch["range"], pa.array(before), pa.array(span)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(batch[c] for c in (*KEY, "ids"))],
                names=["range", "before", "span", *KEY, "ids"],
            )

    schema = "range int, before long, span long, doc_id long, text_key long, ids binary"
    return rows.sortWithinPartitions(*order).mapInArrow(placed, schema)


def write_shards(
    docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = ORDER_KEY
) -> int:
    """Write the byte tokens of texts, apart; returns how many sequences there are."""
    return write_ids(byte_ids(docs), path, 1, PAD, length, per_shard, key)


def write_ids(
    ids: DataFrame,
    path: str,
    width: int,
    pad: int,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = ORDER_KEY,
    apart: bool = True,
) -> int:
    """Write the shards of (doc_id, text_key, ids of `width` bytes each) under `path`; returns
    how many sequences there are."""
    spark = ids.sparkSession
    rows = in_order(ids, width, length, apart)
    staged = new_path(spark, "token_ids")  # encoded once, read for sums and for cutting
    rows.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    release(spark)
    totals = rows.groupBy("range").agg(F.max(F.col("before") + F.col("span"))).collect()
    base, n_ids = {}, 0  # one number a range
    for r, total in sorted(totals):
        base[r], n_ids = n_ids, n_ids + total
    n = -(-n_ids // length)
    said = {
        "sequences": n, "length": length, "width": width, "pad": pad, "per_shard": per_shard,
        "key": key,
    }

    def cut(batches: Iterator[pa.RecordBatch], within: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE)
                bases = np.array([base[r] for r in rows["range"].to_pylist()], "int64")
                first = bases + rows["before"].to_numpy()
                size = pc.binary_length(rows["ids"]).to_numpy().astype("int64") // width
                whole = np.flatnonzero(size)
                parts = np.zeros(len(size), "int64")
                parts[whole] = (first + size - 1)[whole] // length - first[whole] // length + 1
                which = np.repeat(np.arange(len(size)), parts)
                part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                number = first[which] // length + part
                start = np.maximum(number * length - first[which], 0)
                end = np.minimum((number + 1) * length - first[which], size[which])
                slot = permuted(number, n, key) if len(number) else number
                mine = (slot >= within[0] * per_shard) & (slot < within[1] * per_shard)
                which, part, start, end, slot = (x[mine] for x in (which, part, start, end, slot))
                data = rows["ids"].to_pylist()
                own = [
                    codec.compress(data[i][a * width : b * width], asbytes=True)
                    for i, a, b in zip(which.tolist(), start.tolist(), end.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot, "int64"),
                        pa.array(slot // per_shard, "int64"),
                        pa.array((slot % per_shard).astype("int32")),
                        pa.array(((first[which] + start) % length).astype("int32")),
                        rows["doc_id"].take(pa.array(which)),
                        rows["text_key"].take(pa.array(which)),
                        pa.array(part.astype("int32")),
                        pa.array(start, "int64"),
                        pa.array((end - start).astype("int32")),
                        pa.array(own, "binary"),
                    ],
                    names=[c.split()[0] for c in INDEX.split(", ")] + ["data"],
                )

    shards = max(-(-n // per_shard), 1)
    turns = min(TURNS, shards)
    for turn in range(turns):
        within = turn * shards // turns, (turn + 1) * shards // turns
        pieces = rows.mapInArrow(partial(cut, within=within), f"{INDEX}, data binary")
        index = written(pieces, path, said, True, within).write.option("compression", "zstd")
        index.mode("append" if turn else "error").parquet(f"{path}/index")
        del pieces, index
        release(spark)
    delete(spark, staged)
    files, folder = FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(said).encode())
    return n


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shards/{shard:09d}.bin"


def rows_in(said: dict, shard: int) -> int:
    return min(said["per_shard"], said["sequences"] - shard * said["per_shard"])


def written(
    pieces: DataFrame, path: str, said: dict, packed: bool = False, within: tuple | None = None
) -> DataFrame:
    """The index of pieces; whoever reads it writes their shards. All pieces of a shard must be
    among them; `within` (from, to) tells which shards there may be. Their `data` may be packed
    for the shuffle; the files hold plain ids."""
    per_shard, length, width = said["per_shard"], said["length"], said["width"]
    filler = said["pad"].to_bytes(width, "little")
    stride = length * width
    begin, end = within or (0, max(-(-said["sequences"] // per_shard), 1))
    each = -(-(end - begin) // MOST_TASKS)
    task = F.floor((F.col("shard") - begin) / each).cast("int")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = FileSystem.from_uri(path)
        files.create_dir(f"{folder}/shards", recursive=True)
        codec = pa.Codec("zstd")
        shard, out, at, name = -1, None, 0, ""

        def finish():
            out.write(filler * ((rows_in(said, shard) * stride - at) // width))
            out.close()
            files.move(name, shard_file(folder, shard))

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("shard", "row", "offset", "n_ids", "data")]
            for of, row, offset, n_ids, data in zip(*columns, strict=True):
                if of != shard:
                    if out is not None:
                        finish()
                    shard, at = of, 0
                    name = f"{shard_file(folder, shard)}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(name, buffer_size=1 << 20)
                start = row * stride + offset * width
                out.write(filler * ((start - at) // width))
                if packed:
                    data = codec.decompress(data, n_ids * width, asbytes=True)
                out.write(data)
                at = start + len(data)
            yield batch.drop_columns(["data"])
        if out is not None:
            finish()

    return (
        pieces.repartitionById(-(-(end - begin) // each), task)
        .sortWithinPartitions("slot", "offset")
        .mapInArrow(filled, INDEX)
    )


def manifest(path: str) -> dict:
    files, folder = FileSystem.from_uri(path)
    with files.open_input_stream(f"{folder}/manifest.json") as said:
        return json.loads(said.read())


def lost_shards(spark: SparkSession, path: str) -> list[int]:
    """Shards whose file is absent or has another size than the manifest says."""
    said = manifest(path)
    stride = said["length"] * said["width"]

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = FileSystem.from_uri(path)
        for batch in batches:
            infos = files.get_file_info([shard_file(folder, s) for s in batch["id"]])
            lost = [
                info.type != FileType.File or info.size != rows_in(said, shard) * stride
                for shard, info in zip(batch["id"], infos, strict=True)
            ]
            yield batch[lost]

    shards = -(-said["sequences"] // said["per_shard"])
    return sorted(r.id for r in spark.range(shards).mapInPandas(looked, "id long").collect())


def rewrite_shards(ids: DataFrame, path: str, shards: list[int]) -> None:
    """Write shards again from the ids and the index."""
    spark, said = ids.sparkSession, manifest(path)
    own = F.broadcast(spark.createDataFrame([(s,) for s in shards], "shard long"))
    pieces = spark.read.schema(INDEX).parquet(f"{path}/index").join(own, "shard", "left_semi")
    known = ids.select(*(F.col(c).alias(f"_{c}") for c in KEY), "ids")
    on = pieces["doc_id"].eqNullSafe(known["_doc_id"]) & (pieces["text_key"] == known["_text_key"])
    needed = known.join(pieces, on, "left_semi").dropDuplicates(["_doc_id", "_text_key"])
    width = F.lit(said["width"])
    data = F.substring("ids", (F.col("start") * width + 1).cast("int"), F.col("n_ids") * width)
    names = [c.split()[0] for c in INDEX.split(", ")]
    again = pieces.join(needed, on).select(*names, data.alias("data"))
    written(again, path, said).write.format("noop").mode("overwrite").save()


def read_sequences(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """slot, shard, row, ids from `from_slot` on: earlier shards are not opened, and the first
    one is read from its row on. Sort by slot for the training order."""
    said = manifest(path)
    stride, per_shard = said["length"] * said["width"], said["per_shard"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = FileSystem.from_uri(path)
        for batch in batches:
            for shard in batch["id"].to_pylist():
                row = max(from_slot - shard * per_shard, 0)
                rows = rows_in(said, shard)
                with files.open_input_file(shard_file(folder, shard)) as file:
                    file.seek(row * stride)
                    while row < rows:
                        data = file.read(min(AT_ONCE, rows - row) * stride)
                        own = [data[i : i + stride] for i in range(0, len(data), stride)]
                        at = np.arange(row, row + len(own))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard * per_shard + at),
                                pa.array(np.full(len(own), shard, "int64")),
                                pa.array(at.astype("int32")),
                                pa.array(own, "binary"),
                            ],
                            names=["slot", "shard", "row", "ids"],
                        )
                        row += len(own)

    first, end = from_slot // per_shard, -(-said["sequences"] // per_shard)
    tasks = min(max(end - first, 1), MOST_TASKS)
    shards = spark.range(min(first, end), end, 1, tasks)
    return shards.mapInArrow(read, "slot long, shard long, row int, ids binary")


def read_index(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """The pieces of texts in the sequences from `from_slot` on: `n_ids` ids of a text after its
    first `start`, which stand `offset` ids after the start of the sequence."""
    return spark.read.schema(INDEX).parquet(f"{path}/index").filter(F.col("slot") >= from_slot)


def read_shards(
    spark: SparkSession, path: str, from_slot: int = 0, per_shard: int = PER_SHARD
) -> DataFrame:
    """The pieces from `from_slot` on with the ids of their whole sequences."""
    if manifest(path)["per_shard"] != per_shard:
        raise ValueError(f"{path} has shards of other sizes")
    sequences = read_sequences(spark, path, from_slot).select("slot", "ids")
    return read_index(spark, path, from_slot).drop("text_key").join(sequences, "slot")


def materialise(
    docs: DataFrame,
    vocabulary_file: str | None = None,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    apart: bool = False,
) -> str:
    """Write shards, of BPE ids if a vocabulary is given, to the shared folder; their path."""
    path = new_path(docs.sparkSession, "token_shards")
    ids, width, pad = byte_ids(docs), 1, PAD
    if vocabulary_file is not None:
        ids, width, _, pad = bpe_ids(docs, vocabulary_file)
    write_ids(ids, path, width, pad, length, per_shard, apart=apart)
    return path


def materialised(
    docs: DataFrame, vocabulary_file: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """Shards in the shared folder, read back."""
    path = materialise(docs, vocabulary_file, length, per_shard)
    return read_shards(docs.sparkSession, path, per_shard=per_shard)

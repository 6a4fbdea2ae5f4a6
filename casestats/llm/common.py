"""What several operators share: row keys, folding of letters, staged tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casestats.session import configure
from casestats.sources.staging import drop_staged, release, shared_dir, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A side of a join is broadcast only after a count within this bound.
BROADCAST_ROWS = 200_000

KEY = ["doc_id", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Apply the session settings and hand this package to the Python workers.

    The driver serves the archive to every executor, also to ones that join later, so the
    package need not be installed on them.
    """
    configure(spark)
    # Rows of long texts: a smaller batch bounds what a Python worker holds.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="casestats-package-")  # on the driver, until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}_{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): a row is known by its id and a hash of its text.

    Repeated rows have one key and one result; rows that share an id but not the text
    stay apart. Other columns are left out, so none can clash.
    """
    text = F.col("text")
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text)


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def join_keyed(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """`a` joined to `b` on the row key, NULL ids included; the key comes from `a`."""
    b = b.withColumnsRenamed({c: f"_{c}" for c in KEY})
    on = a["doc_id"].eqNullSafe(b["_doc_id"]) & (a["text_key"] == b["_text_key"])
    joined = a.join(b, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_{c}" for c in KEY))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; NULL as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that is no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_rows(docs: DataFrame, bad: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of `docs`, all columns, whose (id, text) is not among the keys of `bad`."""
    names = {c: free_name(docs, f"_key_{c}") for c in KEY}
    # Written first: the size is counted and the join made from the same rows.
    bad = stage(bad.select(*KEY).distinct(), "keys").withColumnsRenamed(names)
    on = docs["doc_id"].eqNullSafe(bad[names["doc_id"]]) & (
        F.xxhash64(docs["text"]) == bad[names["text_key"]]
    )
    return docs.join(if_small(bad), on, how)


def if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if counted to be within `max_rows`; else left to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/casestats/{name}-{uuid.uuid4().hex}"


_built: dict[str, object] = {}


def once(name: str, make: Callable):
    """What `make` makes, kept for later tasks of this Python worker until another is asked for.

    Workers serve one operator after the other: what an earlier one kept must not stay beside.
    """
    if name not in _built:
        _built.clear()
        _built[name] = make()
    return _built[name]


def let_go(spark: SparkSession) -> None:
    """Have the idle Python workers forget what `once` kept, before steps that don't ask for it.

    An executor hands its idle workers out in turn, so a few short tasks a core meet them all.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).mapInPandas(_forgotten, "id long").agg(F.count("id")).first()


def _forgotten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    _built.clear()
    yield from batches


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The same rows in small frames, so that results of one frame stay small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


__all__ = [
    "BROADCAST_ROWS", "KEY", "drop_staged", "fold_ascii", "free_name", "if_small", "join_keyed", "keyed",
    "let_go", "new_path", "once", "ready", "release", "same_key", "shared_dir", "slices", "stage", "table",
    "without_rows",
]

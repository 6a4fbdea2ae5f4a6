"""Intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import warnings
from contextlib import suppress
from pathlib import Path
from urllib.parse import urlsplit

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

MANIFEST = "run STRING, name STRING, path STRING, written_at TIMESTAMP"

# The folder made for each application that names none.
_own_dirs: dict[str, str] = {}

# The folder found on a cluster, by application and the folder named.
_found_dirs: dict[tuple[str, str | None], str] = {}


def require_shared(folder: str, master: str, default_fs: str = "") -> None:
    """Refuse a folder on each machine's own disk, unless all runs on one machine.

    A path without a scheme lies where the cluster's default file system is.
    """
    scheme = urlsplit(folder).scheme or urlsplit(default_fs).scheme
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} is {folder}: executors would not share it")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`, or by `setCheckpointDir`.

    On a cluster a path on disk may be a mount that all machines share or each one's own disk: it
    is tried. Without a named folder that is shared, the warehouse serves, or the user's home on
    the default file system. A folder of our own is made, once per application, only in local
    mode with both settings left out.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if context.master.startswith("local"):
        if folder:
            return folder
        # Kept here, as Spark lets nobody change that setting in a running session. Resolved, as a
        # temp folder may be named by the working folder, which differs between processes.
        if context.applicationId not in _own_dirs:
            made = Path(tempfile.mkdtemp(prefix="casestats-")).resolve()
            _own_dirs[context.applicationId] = made.as_uri()
        return _own_dirs[context.applicationId]
    key = context.applicationId, folder
    if key not in _found_dirs:
        _found_dirs[key] = _found_dir(spark, folder)
    return _found_dirs[key]


def _found_dir(spark: SparkSession, named: str | None) -> str:
    master, default_fs = spark.sparkContext.master, default_file_system(spark)
    refused = ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if named:
        try:
            require_shared(named, master, default_fs)
            return named
        except ValueError as told:
            if executors_share(spark, named):
                return named
            refused = told
    others = [spark.conf.get("spark.sql.warehouse.dir")]
    if urlsplit(default_fs).scheme not in ("", "file"):
        others.append(_file_system(spark, default_fs)[0].getHomeDirectory().toString())
    for other in others:
        folder = f"{other.rstrip('/')}/casestats-staging"
        if executors_share(spark, folder):
            warnings.warn(f"{refused}; intermediate tables go to {folder}", stacklevel=4)
            return folder
    raise refused


def executors_share(spark: SparkSession, folder: str) -> bool:
    """Whether the driver sees what the executors write to a folder, and they what it sees.

    A few short tasks a core write, so that each executor there is takes part.
    """
    path = f"{folder}/casestats/tried-{uuid.uuid4().hex}"
    tasks = 4 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).count() == tasks
    except (PySparkException, Py4JError):
        return False
    finally:
        with suppress(Py4JError):
            delete(spark, path)


def default_file_system(spark: SparkSession) -> str:
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or ""


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    A lost executor then costs a re-read instead of a rebuild. The written table has a
    known size, so Spark can decide on a broadcast by it, and a join against it shuffles
    both sides itself, which is the shape in which adaptive execution splits a hot key.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark) + '/casestats'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that are not read any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps.

    It does so for shuffles that the driver's garbage collection finds unused, by itself every
    half hour (`spark.cleaner.periodicGC.interval`): too seldom for a step after step job.
    A frame that Python dropped is in use until the gateway has passed that on, which it does
    about once a second; so this waits for it, a few seconds at most.
    """
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while dropped and time.monotonic() < until:
        time.sleep(0.02)
    # As measured, the files go after the second collection, not after the first.
    for _ in range(2):
        time.sleep(0.2)
        spark._jvm.System.gc()


class Staging:
    """Intermediate tables of one run. Its manifest lists what it wrote; `close` deletes that.

    A run that was cut off leaves its folder and manifest behind: see `abandoned`.
    """

    def __init__(self, spark: SparkSession, run: str | None = None):
        self.spark = spark
        self.run = run or uuid.uuid4().hex
        self.folder = f"{shared_dir(spark)}/casestats/runs/{self.run}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        written = stage(df, name, self.folder)
        entry = self.spark.range(1).select(
            F.lit(self.run).alias("run"),
            F.lit(name).alias("name"),
            F.lit(self.folder).alias("path"),
            F.current_timestamp().alias("written_at"),
        )
        entry.write.parquet(f"{self.folder}/manifest/{name}-{uuid.uuid4().hex}")
        return written

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/*")

    def close(self) -> None:
        delete(self.spark, self.folder)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def abandoned(spark: SparkSession, older_than_hours: float = 48) -> list[str]:
    """Delete the folders of runs that wrote nothing for so long; their names."""
    root = f"{shared_dir(spark)}/casestats/runs"
    runs = [run for run in folders(spark, root) if folders(spark, f"{root}/{run}/manifest")]
    if not runs:
        return []
    manifests = spark.read.schema(MANIFEST).parquet(*[f"{root}/{run}/manifest/*" for run in runs])
    last = F.unix_timestamp(F.max("written_at"))
    seconds = F.unix_timestamp(F.current_timestamp()) - last
    old = manifests.groupBy("path").agg(seconds.alias("seconds"))
    gone = [r.path for r in old.filter(F.col("seconds") >= older_than_hours * 3600).collect()]
    for folder in gone:
        delete(spark, folder)
    return gone


def _file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, whichever store that is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

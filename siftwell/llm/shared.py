"""Tables in the folder that driver and executors share, to cut lineage and to pass over results once."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one for a local master, and an error for a
    cluster, whose executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="siftwell-"))
    path = f"{base.rstrip('/')}/siftwell-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    atexit.register(delete, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the shared folders made within it at its end. What is still to be read must be in a folder made before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder if the session still runs."""
    if spark.sparkContext._jsc is not None:
        where, files = folder(spark, path)
        files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, files = folder(spark, path)
    return files.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, in order of name; nothing if it doesn't exist."""
    where, files = folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, which is one step on HDFS and local disks; False if the target exists."""
    (old, files), (new, _) = folder(spark, source), folder(spark, target)
    files.mkdirs(new.getParent())
    return not files.exists(new) and files.rename(old, new)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet to a shared folder and read again."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(name: str, *tables: DataFrame) -> str:
    """The name, with marks after it until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has rows with whole texts go to Python by the thousand, unless the session has its own setting. Plans are made when a
    result is asked for, so this stays on for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def give_back() -> None:
    """Gives what this worker has freed back to the system: workers are kept for later tasks, and what they hold counts while the executor does other work."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(scan):
    """The function from batches to batches, with `give_back` at its end."""

    def run(batches):
        yield from scan(batches)
        give_back()

    return run

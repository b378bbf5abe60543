"""Cutting plans that grow step by step."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary one serves a
    local master; a cluster needs the setting."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="siftwell-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


def files_of(spark: SparkSession, path: str):
    """A path and its file system, as Spark's readers see them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It is deleted when the session's process ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"

    def delete():
        if spark.sparkContext._jsc is not None:
            where, files = files_of(spark, path)
            files.delete(where, True)

    atexit.register(delete)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder: smaller than a checkpoint, and read by column."""
    path = folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another table in the same place has another one."""
    where, files = files_of(spark, path)
    parts = files.listStatus(where)
    return tuple(sorted((p.getPath().toString(), p.getLen(), p.getModificationTime()) for p in parts))

"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode (tests, a single
    machine), and an error on a cluster, whose executors share no local folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='auditloom-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that Hadoop's file system removes when the JVM ends."""
    path = f"{shared_dir(spark)}/auditloom-{name}-{uuid.uuid4().hex}"
    target, files = hadoop(spark, path)
    files.deleteOnExit(target)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Remove what stands under a path of ``new_path`` that nothing reads any more."""
    target, files = hadoop(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = hadoop(spark, path)
    return files.exists(target)


def mark(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own, put in the place of one that stands there."""
    target, files = hadoop(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stash_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs survive lost executors."""
    return stash_at(df, new_path(df.sparkSession, name))

"""Working storage every executor can reach.

Results that several branches of a plan read are written once as parquet below
``spark.checkpoint.dir``.  A written table survives lost executors, cuts the
lineage, keeps file statistics for join planning and allows column pruning.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "ledgerlake"


def shared_root(spark: SparkSession) -> str:
    """Folder of this application inside the cluster's checkpoint directory.

    It is deleted when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _context_base(spark)
    root = f"{base.rstrip('/')}/{_FOLDER}/{spark.sparkContext.applicationId}"
    files, path = _file_system(spark, root)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def _context_base(spark: SparkSession) -> str:
    """The directory given to ``setCheckpointDir``; a folder of this machine only where it is all there is."""
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_base()


@cache
def _own_base() -> str:
    """Stands in where the setting is empty, as in single-machine runs."""
    return tempfile.mkdtemp(prefix="ledgerlake-")


def _file_system(spark: SparkSession, location: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table or streaming directory."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str) -> str:
    """Write ``df`` to a fresh shared path and return the path."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = write_shared(df, label)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one step, deleted when the step ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def path(self, label: str) -> str:
        path = shared_path(self.spark, label)
        self.paths.append(path)
        return path

    def write(self, df: DataFrame, label: str) -> str:
        path = self.path(label)
        df.write.parquet(path)
        return path

    def materialize(self, df: DataFrame, label: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, label))

    def __exit__(self, *error) -> None:
        for location in self.paths:
            files, path = _file_system(self.spark, location)
            files.delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote so far."""
    files, path = _file_system(spark, shared_root(spark))
    files.delete(path, True)

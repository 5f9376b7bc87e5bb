"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has been counted and its size is
#: below this many bytes; above it the same join runs as a shuffle join.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session, where both are one process, gets an own folder if it
    names none; on a cluster that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder that is there to be read even if nothing is ever written to it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the rows survive a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, before: int = 0) -> None:
    """Remove the intermediate tables that ``written`` has made since it had made
    ``before`` of them.  Only for when all results that read them are stored."""
    for path in _WRITTEN[before:]:
        remove_folder(spark, path)
    del _WRITTEN[before:]


def made() -> int:
    """How many intermediate tables there are; see ``release``."""
    return len(_WRITTEN)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is below the bound."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose joins are never made by a broadcast that nobody asked for.  Spark takes
    the size of a file for that of its rows; names and code that repeat are a hundredth
    of their size in a file, and what looks small would go through the driver."""
    return df.hint("merge")

"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows are estimated to take at most so many bytes.
BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs on this machine alone, a new temporary folder."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps and lost executors start from there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if it is small enough; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    files = df.inputFiles()
    for entry in [w for w in _written if any(f"/{w[1].rsplit('/', 1)[1]}/" in f for f in files)]:
        _written.remove(entry)
        _delete(*entry)


@atexit.register
def release() -> None:
    """Delete the tables written so far; results that still read them must have been stored."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session has ended; the folder's owner clears it
            return

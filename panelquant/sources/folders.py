"""Folders for tables that outlive a job, in the place that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs on this machine alone, a new temporary folder."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def passing(spark: SparkSession, name: str) -> str:
    """A new folder that is deleted when the driver ends."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows written to a folder so far; none if there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@atexit.register
def _release() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner clears it
            return

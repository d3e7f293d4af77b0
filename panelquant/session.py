"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster, install the package or pass it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))

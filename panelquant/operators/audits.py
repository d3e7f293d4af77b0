"""Checks that datasets, folds and predictions are what they should be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .learning import log_loss


def label_balance(rows: DataFrame, keys: Sequence[str] = ("series_id",), y: str = "y") -> DataFrame:
    """Rows and share of each label."""
    counts = rows.groupBy(*keys, y).agg(F.count("*").alias("months"))
    return counts.withColumn("share", F.col("months") / F.sum("months").over(Window.partitionBy(*keys)))


def fold_scores(rows: DataFrame, proba: str, reference: str, keys: Sequence[str]) -> DataFrame:
    """Mean log loss of two columns of class probabilities."""
    place = F.col("y") + 1
    return rows.groupBy(*keys).agg(
        F.count("*").alias("months"), F.avg(log_loss(proba, place)).alias("log_loss"), F.avg(log_loss(reference, place)).alias("reference_log_loss")
    )


def paired_folds(first: DataFrame, second: DataFrame, metric: str, keys: Sequence[str] = ("series_id", "fold")) -> DataFrame:
    """A metric of two reports on the folds that both have, and its difference."""
    one = first.select(*keys, F.col(metric).alias("first"))
    return one.join(second.select(*keys, F.col(metric).alias("second")), list(keys)).withColumn("delta", F.col("first") - F.col("second"))


def largest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def leakage_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by role, and training rows that overlap the fold's test span or start no earlier than it."""
    test = F.col("role") == "test"
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"s": F.min(F.when(test, F.col("t0"))).over(w), "e": F.max(F.when(test, F.col("t1"))).over(w)})
    train = F.col("role") == "train"
    return rows.groupBy(*keys).agg(
        F.count_if(test).alias("test_rows"),
        F.count_if(train).alias("train_rows"),
        F.count_if(F.col("role") == "purged").alias("purged_rows"),
        F.count_if(train & (F.col("t1") >= F.col("s")) & (F.col("t0") <= F.col("e"))).alias("overlapping"),
        F.count_if(train & (F.col("t0") >= F.col("s"))).alias("later"),
    )


def return_cross_check(rows: DataFrame, bars: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Forward returns compounded over all rows of a series, against the price at the first t0 and the last t1."""
    spans = rows.groupBy("series_id").agg(
        F.min("t0").alias("a"), F.max("t1").alias("b"), F.count("*").alias("months"), (F.product(1 + F.col("forward_return")) - 1).alias("compounded")
    )
    ends = bars.select("series_id", "date", "close").join(spans, "series_id").where("date = a or date = b")
    price = lambda end: F.max(F.when(F.col("date") == F.col(end), F.col("close")))
    out = ends.groupBy("series_id", "months", "compounded").agg((price("b") / price("a") - 1).alias("by_prices"))
    return out.withColumn("agrees", F.abs(F.col("compounded") - F.col("by_prices")) < tolerance)


def key_counts(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and keys that occur more than once."""
    counts = rows.groupBy(*key).count()
    return counts.groupBy(*by).agg(F.sum("count").alias("predictions"), F.count("*").alias("keys"), F.count_if(F.col("count") > 1).alias("repeated"))


def importances(spark: SparkSession, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """(feature, importance): coefficients of a linear last stage on standardised features, or a forest's importances."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return spark.createDataFrame(list(zip(columns, map(float, values.toArray()))), "feature string, importance double")

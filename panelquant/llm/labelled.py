"""Training rows for the classifiers: a bounded sample of labelled documents, and held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; false without an id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, limit: int) -> DataFrame:
    """(id, label, text) of at most ``limit`` labelled rows for which ``train`` holds (a condition on ``id``).

    The rows with the smallest hash of their id are taken; an id with several
    labels has the largest. The ids are at most ``limit``, so they are broadcast.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label is not null").where(train)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")

"""A corpus pipeline of five stages; each takes what its predecessor kept.

Stages 3 and 4 number the rows that they get and store them so, and tell rows apart by that number:
rows that share an id but not the text stand for themselves, and a row without id is treated like any other.

Cases: a null or empty text has no words: the line, join and benchmark stages keep it, and
packing gives it the end id; of rows that repeat with id and text, stage 3 keeps one; of a group
of near duplicates it keeps the row with the smallest id (of equal ids, with the smallest hash of its text), rows without id coming last;
texts of any length are processed whole; extra columns go through the stages up to packing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelquant.llm import decontaminate, line_dedup, ngram_join, packing, quality
from panelquant.llm.labelled import held_out
from panelquant.llm.scratch import small, stored, unused
from panelquant.llm.tokenizer import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, stored, so that every later reading meets the same numbers; and that column's name."""
    (row,) = unused(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _among(docs: DataFrame, row: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose number is (``left_semi``) or isn't (``left_anti``) in the column ``key`` of a stored table."""
    (name,) = unused(docs, "own_key")
    keys = keys.select(F.col("key").alias(name))
    return docs.join(small(keys, 16), F.col(row) == F.col(name), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~held_out(F.col("id"), 3, 1), "quality")
    return quality.kept(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose like stands earlier go; a document of which nothing is left goes with them."""
    out = line_dedup.drop_duplicate_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents (Jaccard similarity of five-word shingles 0.8 or more), the one with the smallest id stays."""
    columns = docs.columns
    docs, row = _numbered(docs)
    found = ngram_join.jaccard_components(docs.select(F.col(row).alias("doc_id"), "text"), words=5, num=80)
    found = stored(found.select(F.col("doc_id").alias("key"), "component_id"), "groups")
    roots = found.where("key <> component_id").select("component_id").distinct()
    grouped = stored(found.join(roots, "component_id"), "grouped")
    rows = docs.select(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("key"))
    own = F.struct("last", "id", "hash", "key")
    keepers = rows.join(grouped, "key").groupBy("component_id").agg(F.min(own).getField("key").alias("keeper"))
    gone = stored(grouped.join(keepers, "component_id").where("key <> keeper").select("key"), "gone")
    # texts without words link with nothing; their repeated rows go too
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    blank = docs.where(~has_words)
    first = blank.select("doc_id", "text", F.col(row).alias("key")).groupBy("doc_id", "text").agg(F.min("key").alias("key"))
    first = stored(first.select("key"), "first")
    out = _among(docs.where(has_words), row, gone, "left_anti").unionByName(_among(blank, row, first, "left_semi"))
    return out.select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten words of the benchmark go."""
    columns = docs.columns
    docs, row = _numbered(docs)
    index = decontaminate.build_index(docs.select(F.col(row).alias("doc_id"), "text"))
    found = decontaminate.contamination(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(found.where(F.size("hits") > 0).select(F.col("doc_id").alias("key")).distinct(), "gone")
    return _among(docs, row, gone, "left_anti").select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenized and packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the fitted classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

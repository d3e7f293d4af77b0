"""Fitted features as a stored table, addressed by what they were computed from.

A series' key is the SHA-256 of its bars and of the parameters. Rows of a key are computed once, by
walk-forward refits, and read ever after; they carry ``causal_from``, the first day whose
label comes from a model that saw earlier days only. Strategies that learn from them
are out of sample from the later of that day and the day after their own learning ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelquant.operators import indicators, regimes

from .folders import table

HMM = "key string, series_id string, date date, regime_hmm int, prob array<double>, causal_from date"
STATES, FIRST, EVERY = 3, 504, 63


def series_keys(bars: DataFrame, **parameters) -> DataFrame:
    """(series_id, key): a hash of all columns of a series' bars in order, and of the parameters."""
    columns = sorted(c for c in bars.columns if c not in ("series_id", "date"))
    line = F.concat_ws(":", F.date_format("date", "yyyy-MM-dd"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    content = F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256)
    of = F.lit(repr((columns, sorted(parameters.items()))))
    return bars.groupBy("series_id").agg(F.sha2(F.concat_ws("#", content, of), 256).alias("key"))


def _state_order(means: str, k: int, dims: int, by: int) -> Column:
    """State numbers from the lowest to the highest mean of one column."""
    each = F.array(*[F.struct(F.col(means)[i * dims + by].alias("mean"), F.lit(i).alias("state")) for i in range(k)])
    return F.transform(F.array_sort(each), lambda s: s["state"])


def walk_forward_hmm(bars: DataFrame, columns: Sequence[str] | None = None, states: int = STATES, first: int = FIRST, every: int = EVERY) -> DataFrame:
    """(series_id, date, regime_hmm, prob, causal_from): filtered states of refitted models, numbered from calm to wild volatility.

    ``columns`` are regime features (all by default); the first of them must be the volatility.
    """
    features = indicators.regime_features(bars)
    columns = list(columns or regimes.feature_columns(features))
    ready = regimes.complete_rows(features, columns).where("ready").drop("ready")
    plan = regimes.refit_schedule(ready, first, every)
    models = regimes.fit_hmm(plan, columns, states)
    order = models.select("model_id", _state_order("means", states, len(columns), columns.index("vol_20d")).alias("order"))
    labels = regimes.hmm_labels(plan.where("fit or test"), columns, models)
    rows = labels.join(plan.where("test").select("model_id", "series_id", "date"), ["model_id", "series_id", "date"]).join(order, "model_id")
    rows = rows.select(
        "series_id", "date", (F.array_position("order", F.col("label")) - 1).cast("int").alias("regime_hmm"), F.transform("order", lambda s: F.col("prob")[s]).alias("prob")
    )
    causal = plan.where("test").groupBy("series_id").agg(F.min("date").alias("causal_from"))
    return rows.join(causal, "series_id")


def hmm_features(spark: SparkSession, path: str, bars: DataFrame, columns: Sequence[str] | None = None, states: int = STATES, first: int = FIRST, every: int = EVERY) -> DataFrame:
    """The stored features of the given bars; series whose key isn't stored yet are fitted and added, and no others."""
    keys = series_keys(bars, columns=tuple(columns or ()), states=states, first=first, every=every)
    missing = keys.join(table(spark, path, HMM).select("key").distinct(), "key", "left_anti")
    if not missing.isEmpty():
        fitted = walk_forward_hmm(bars.join(missing.select("series_id"), "series_id", "left_semi"), columns, states, first, every)
        fitted.join(missing, "series_id").select("key", "series_id", "date", "regime_hmm", "prob", "causal_from").write.mode("append").parquet(path)
    return table(spark, path, HMM).join(keys, ["series_id", "key"])


def attached(rows: DataFrame, stored: DataFrame, at: str = "t0", states: int = STATES) -> DataFrame:
    """Samples with ``regime_hmm`` and ``hmm_p0`` to ``hmm_p<n>`` of their day; null before ``causal_from``."""
    own = stored.where(F.col("date") >= F.col("causal_from"))
    own = own.select("series_id", F.col("date").alias(at), F.col("regime_hmm").cast("double").alias("regime_hmm"), *[F.col("prob")[i].alias(f"hmm_p{i}") for i in range(states)])
    return rows.join(own, ["series_id", at], "left")


def causal_starts(labels: DataFrame) -> DataFrame:
    """(series_id, causal_from) of labels by a model fitted once: the first labelled day after the rows marked ``fit``; null if there is none."""
    last = labels.groupBy("series_id").agg(F.max(F.when(F.col("fit"), F.col("date"))).alias("last"))
    later = labels.join(last, "series_id").where(F.col("last").isNull() | (F.col("date") > F.col("last")))
    return last.select("series_id").join(later.groupBy("series_id").agg(F.min("date").alias("causal_from")), "series_id", "left")


def out_of_sample_from(ends: DataFrame, causal: DataFrame) -> DataFrame:
    """(series_id, learn_end, oos_from): the later of the day after learning and the first causal day; without a causal day, never."""
    rows = ends.join(causal.select("series_id", "causal_from"), "series_id", "left")
    return rows.select("series_id", "learn_end", F.when(F.col("causal_from").isNotNull(), F.greatest("oos_from", "causal_from")).alias("oos_from"))

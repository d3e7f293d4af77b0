"""Whole request tables as one job: every valid request becomes a run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtest import run_backtest
from .reports import full_report
from .ml_signals import CATALOG


def run_requests(bars: DataFrame, requests: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """A full report for each request (request_id, strategy, params, ticker, start, end), keyed by run_id.

    Requests are grouped by (strategy, params), of which there are few: each is one
    signal plan over the bars of its requests, and all runs share one backtest.
    """
    plans = [tuple(r) for r in requests.select("strategy", F.map_entries("params").alias("p")).distinct().collect()]
    signals = []
    for name, entries in sorted(plans, key=str):
        params = {e[0]: e[1] for e in entries or []}
        whole = {k: int(v) if float(v).is_integer() and k in ("short_window", "long_window", "lookback", "period") else v for k, v in params.items()}
        own = requests.where((F.col("strategy") == name) & (F.map_entries("params") == _entries(params)))
        cut = bars.join(own.select(F.col("request_id").alias("run_id"), F.col("ticker").alias("series_id"), "start", "end"), "series_id")
        cut = cut.where("date >= start and date < end").withColumn("name", F.col("series_id"))
        keyed = cut.withColumn("series_id", F.concat_ws("\u0001", "run_id", "series_id"))
        signals.append(CATALOG[name].signals(keyed, **whole).join(keyed.select("series_id", "date", "close"), ["series_id", "date"]))
    rows = reduce(lambda a, b: a.unionByName(b), signals)
    result = run_backtest(rows.select("series_id", "date", "close"), rows.select("series_id", "date", "signal"), cost_bps)
    parts = F.split("series_id", "\u0001")
    return full_report(result.withColumn("run_id", parts[0]).withColumn("series_id", parts[1]), ["run_id", "series_id"])


def _entries(params: dict):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("value")) for k, v in params.items()])


def one_hot(labels: DataFrame, train_end: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """A 0/1 column for each label seen up to ``train_end``; a label unseen by then is 0 in all."""
    seen = labels.where((F.col("date") <= F.lit(train_end).cast("date")) & (F.col("label") != -1))
    values = sorted(r[0] for r in seen.select("label").distinct().collect())  # labels are few
    return labels.select(*keys, "date", *[(F.col("label") == v).cast("double").alias(f"regime_{v}") for v in values])


def merged_series(backtest: DataFrame, runs: Sequence[str], value: str = "equity_curve") -> DataFrame:
    """Several runs' series side by side by date; a date that a run lacks is null."""
    return backtest.groupBy("series_id", "date").pivot("run_id", list(runs)).agg(F.first(value))


def catalog_rows(spark) -> DataFrame:
    """One row a strategy and version, with a hash of its parameter bounds."""
    rows = [(s.name, s.version, str(sorted(s.bounds.items()))) for s in CATALOG.values()]
    return spark.createDataFrame(rows, "name string, version int, bounds string").withColumn("schema_sha256", F.sha2("bounds", 256))


def current_and_retired(registered: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of registered catalog rows, the newest of each name, and those whose name is no longer offered."""
    newest = registered.groupBy("name").agg(F.max("version").alias("version"))
    return registered.join(newest, ["name", "version"]), registered.join(current, "name", "left_anti")

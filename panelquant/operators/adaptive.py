"""Strategies that choose by regime, from evidence up to a learning cutoff."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import DAYS, ordered, rolling, sharpe

from .backtest import run_backtest
from .indicators import with_returns
from .reports import UNKNOWN
from .validation import mark_out_of_sample, numbered

LEAST_DAYS = 60


def learn_ends(bars: DataFrame, share: float = 0.5) -> DataFrame:
    """Each series' last learning date: row int(n * share) - 1, and the day after it."""
    rows = numbered(bars.select("series_id", "date"), ["series_id"]).withColumn("next", F.lead("date").over(ordered()))
    rows = rows.where(F.col("pos") == F.greatest(F.floor(F.col("n") * share) - 1, F.lit(0)))
    return rows.select("series_id", F.col("date").alias("learn_end"), F.col("next").alias("oos_from"))


def evidence(bars: DataFrame, labels: DataFrame, candidates: DataFrame, ends: DataFrame, cost_bps: float = 5.0, least: int = LEAST_DAYS) -> DataFrame:
    """(series_id, label, run_id, days, sharpe): each candidate in each regime up to the cutoff; null under ``least`` days."""
    rows = run_backtest(bars, candidates, cost_bps).join(labels.where(F.col("label") != UNKNOWN), ["series_id", "date"])
    rows = rows.join(F.broadcast(ends), "series_id").where("date <= learn_end")  # one row a series
    rows = rows.withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    table = rows.groupBy("series_id", "label", "run_id").agg(F.count("*").alias("days"), sharpe(F.col("ret")).alias("value"))
    return table.withColumn("sharpe", F.when(F.col("days") >= least, F.col("value"))).drop("value")


def best_per_regime(table: DataFrame, allow_flat: bool = True) -> DataFrame:
    """(series_id, label, choice): the best candidate by Sharpe, the first by name on ties; flat if it isn't above 0; null without evidence."""
    order = Window.partitionBy("series_id", "label").orderBy(F.desc_nulls_last("sharpe"), "run_id")
    best = table.withColumn("place", F.row_number().over(order)).where("place = 1")
    flat = F.col("sharpe") <= 0 if allow_flat else F.lit(False)
    choice = F.when(F.col("sharpe").isNull(), None).when(flat, F.lit("flat")).otherwise(F.col("run_id"))
    return best.select("series_id", "label", choice.alias("choice"), "sharpe", "days")


def margins(table: DataFrame) -> DataFrame:
    """The winner's margin over the runner-up in each regime, and the noise of a Sharpe over as many days."""
    order = Window.partitionBy("series_id", "label").orderBy(F.desc("sharpe"), "run_id")
    rows = table.where("sharpe is not null").withColumns({"place": F.row_number().over(order), "second": F.lead("sharpe").over(order)})
    noise = F.sqrt(F.lit(float(DAYS)) / F.col("days"))
    rows = rows.where("place = 1").select("series_id", "label", F.col("run_id").alias("winner"), (F.col("sharpe") - F.col("second")).alias("margin"), noise.alias("noise"))
    return rows.withColumn("decisive", F.coalesce(F.col("margin") > F.col("noise"), F.lit(False)))


def _marked(rows: DataFrame, ends: DataFrame) -> DataFrame:
    return mark_out_of_sample(rows, ends.select("series_id", "oos_from"), ["series_id"])


def regime_filtered(signals: DataFrame, labels: DataFrame, table: DataFrame, ends: DataFrame, base: str) -> DataFrame:
    """The base signal on days of regimes in which the base earned a positive Sharpe up to the cutoff, flat elsewhere and before."""
    allowed = table.where((F.col("run_id") == base) & (F.col("sharpe") > 0)).select("series_id", "label", F.lit(1.0).alias("allowed"))
    rows = signals.where(F.col("run_id") == base).select("series_id", "date", "signal")
    rows = rows.join(labels, ["series_id", "date"], "left").join(F.broadcast(allowed), ["series_id", "label"], "left")
    rows = rows.select("series_id", "date", (F.col("signal") * F.coalesce("allowed", F.lit(0.0))).alias("signal"))
    return _marked(rows, ends)


def regime_switch(signals: DataFrame, labels: DataFrame, choices: DataFrame, ends: DataFrame, default: float = 0.0) -> DataFrame:
    """On each day the signal of the candidate chosen for its regime."""
    rows = labels.join(F.broadcast(choices.select("series_id", "label", "choice")), ["series_id", "label"], "left")
    rows = rows.join(signals.withColumnRenamed("run_id", "choice"), ["series_id", "date", "choice"], "left")
    rows = rows.select("series_id", "date", F.coalesce("signal", F.lit(float(default))).alias("signal"))
    return _marked(rows, ends)


def volatility_targeted(bars: DataFrame, signals: DataFrame, target: float = 0.10, window: int = 20, cap: float = 1.0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The signal scaled to a target volatility, at most ``cap``; 0 until volatility is known."""
    vol = rolling(F.stddev_samp, F.col("r"), window, ordered()) * F.sqrt(F.lit(float(DAYS)))
    rows = signals.join(with_returns(bars).select("series_id", "date", vol.alias("vol")), ["series_id", "date"])
    scale = target / F.nullif("vol", F.lit(0.0))
    scaled = F.col("signal") * F.when(scale.isNotNull(), F.least(scale, F.lit(cap)))
    return rows.select(*keys, "date", F.coalesce(scaled, F.lit(0.0)).alias("signal"))


def regime_sized(bars: DataFrame, signals: DataFrame, labels: DataFrame, ends: DataFrame) -> DataFrame:
    """The signal sized by the calmest regime's volatility over each regime's, learned up to the cutoff."""
    rows = with_returns(bars).join(labels.where(F.col("label") != UNKNOWN), ["series_id", "date"]).join(F.broadcast(ends), "series_id")
    vols = rows.where("date <= learn_end").groupBy("series_id", "label").agg(F.stddev_samp("r").alias("vol"))
    sizes = vols.withColumn("size", F.min("vol").over(Window.partitionBy("series_id")) / F.nullif("vol", F.lit(0.0)))
    out = signals.join(labels, ["series_id", "date"], "left").join(F.broadcast(sizes), ["series_id", "label"], "left")
    out = out.select("series_id", "date", (F.col("signal") * F.coalesce("size", F.lit(0.0))).alias("signal"))
    return _marked(out, ends)


def regime_parameters(signals: DataFrame, labels: DataFrame, runs: dict[int, str], default: str) -> DataFrame:
    """On each day the signal of the parameter set (run id) of its regime."""
    mapped = reduce(lambda c, kv: F.when(F.col("label") == kv[0], kv[1]).otherwise(c), runs.items(), F.lit(default))
    rows = labels.withColumn("run_id", mapped).join(signals, ["series_id", "date", "run_id"], "left")
    return rows.select("series_id", "date", F.coalesce("signal", F.lit(0.0)).alias("signal"))


def adaptive_ensemble(bars: DataFrame, signals: DataFrame, labels: DataFrame, choices: DataFrame, ends: DataFrame, target: float = 0.10) -> DataFrame:
    return volatility_targeted(bars, regime_switch(signals, labels, choices, ends), target)


def override_days(base: DataFrame, filtered: DataFrame, labels: DataFrame) -> DataFrame:
    """Days on which a filter is flat though its base is not: before labels exist, or by regime."""
    rows = base.select("series_id", "date", F.col("signal").alias("x")).join(filtered.select("series_id", "date", F.col("signal").alias("y")), ["series_id", "date"])
    rows = rows.join(labels, ["series_id", "date"], "left").where((F.col("x") != 0) & (F.col("y") == 0))
    cause = F.when(F.coalesce("label", F.lit(UNKNOWN)) == UNKNOWN, "warm_up").otherwise("excluded_regime")
    return rows.groupBy("series_id", cause.alias("cause")).agg(F.count("*").alias("days"))

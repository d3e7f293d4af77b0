"""Backtests to metrics: whole runs, any slice of them, regimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import DAYS, cagr, ordered, sharpe, so_far, sortino, volatility, win_rate, yearly_from_mean

UNKNOWN = -1


def drawdown(equity: Column, w) -> Column:
    """Decline from the highest value so far, as a negative share."""
    peak = F.max(equity).over(so_far(w))
    return (equity - peak) / peak


def with_equity(rows: DataFrame, keys: Sequence[str], by: str = "date") -> DataFrame:
    """Rebuild equity from 1 on the rows at hand; a missing return counts as 0."""
    w = ordered(keys, by)
    rows = rows.withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    rows = rows.withColumns({"equity": F.product(1 + F.col("ret")).over(so_far(w)), "before": F.lag("position").over(w)})
    return rows.withColumn("drawdown", drawdown(F.col("equity"), w))


def full_report(rows: DataFrame, keys: Sequence[str] = ("run_id", "series_id"), by: str = "date") -> DataFrame:
    """One row a key: returns, risk, exposure and trading of any slice of a backtest."""
    moved = F.abs(F.col("position") - F.col("before"))
    n = F.count("*")
    return (
        with_equity(rows, keys, by)
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            (F.max_by("equity", by) - 1).alias("total_return"),
            F.count_if(moved > 0).alias("num_trades"),
            win_rate(F.col("ret")).alias("win_rate"),
            F.avg(F.abs("position")).alias("exposure"),
            F.when(n < 2, 0.0).otherwise(F.coalesce(F.sum(moved), F.lit(0.0)) / (n / DAYS)).alias("turnover"),
            cagr(F.min_by("equity", by), F.max_by("equity", by), n).alias("cagr"),
            volatility(F.col("ret")).alias("annualized_volatility"),
            sharpe(F.col("ret")).alias("sharpe_ratio"),
            sortino(F.col("ret")).alias("sortino_ratio"),
            F.min("drawdown").alias("max_drawdown"),
        )
    )


def summary_stats(backtest: DataFrame, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """Returns, trades and cost of whole backtests."""
    moved = F.abs(F.col("position") - F.lag("position").over(ordered(keys)))
    rows = backtest.withColumn("moved", moved)
    return rows.groupBy(*keys).agg(
        (F.max_by("equity_curve", "date") - 1).alias("total_return"),
        (F.max_by("benchmark_curve", "date") - 1).alias("benchmark_return"),
        F.count_if(F.col("moved") > 0).alias("num_trades"),
        win_rate(F.col("strategy_return")).alias("win_rate"),
        F.sum("cost").alias("total_cost"),
    )


def performance_by_regime(backtest: DataFrame, labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Metrics over the days of each regime, chained into one curve; unlabelled days are left out."""
    rows = backtest.join(labels.select("series_id", "date", "label"), ["series_id", "date"], "left")
    rows = rows.withColumns({"regime": F.coalesce("label", F.lit(UNKNOWN)), "ret": F.coalesce("strategy_return", F.lit(0.0))})
    w = ordered([*keys, "regime"])
    rows = rows.where(F.col("regime") != UNKNOWN).withColumn("equity", F.product(1 + F.col("ret")).over(so_far(w)))
    rows = rows.withColumn("drawdown", drawdown(F.col("equity"), w))
    return rows.groupBy(*keys, "regime").agg(
        F.count("*").alias("days"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        yearly_from_mean(F.avg("ret")).alias("ann_return"),
        volatility(F.col("ret")).alias("annualized_volatility"),
        sharpe(F.col("ret")).alias("sharpe_ratio"),
        sortino(F.col("ret")).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        win_rate(F.col("ret")).alias("win_rate"),
        F.avg(F.abs("position")).alias("exposure"),
    )


def benchmark_by_regime(backtest: DataFrame, labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    held = backtest.withColumns({"strategy_return": F.col("daily_return"), "position": F.lit(1.0)})
    return performance_by_regime(held, labels, keys)


def regime_mix(labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Share of each label among the labelled days of a key."""
    counts = labels.where(F.col("label") != UNKNOWN).groupBy(*keys, "label").agg(F.count("*").alias("days"))
    return counts.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy(*keys)))


def transition_matrix(labels: DataFrame, states: Sequence[int], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Counts and row shares of moves from one labelled day to the next, zero-filled over ``states``."""
    w = ordered(keys)
    moves = labels.where(F.col("label") != UNKNOWN).withColumn("to", F.lead("label").over(w)).where("to is not null")
    counts = moves.groupBy(*keys, F.col("label").alias("from"), "to").agg(F.count("*").alias("moves"))
    wanted = F.array(*[F.lit(s) for s in states])
    grid = labels.select(*keys).distinct().select(*keys, F.explode(wanted).alias("from")).select("*", F.explode(wanted).alias("to"))
    counts = grid.join(counts, [*keys, "from", "to"], "left").withColumn("moves", F.coalesce("moves", F.lit(0)))
    total = F.sum("moves").over(Window.partitionBy(*keys, "from"))
    return counts.withColumn("share", F.when(total > 0, F.col("moves") / total).otherwise(0.0))


def episodes(labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Runs of one label over the labelled days: start, end, days."""
    w = ordered(keys)
    rows = labels.where(F.col("label") != UNKNOWN).withColumn("new", F.lag("label").over(w).eqNullSafe(F.col("label")))
    rows = rows.withColumn("block", F.count_if(~F.col("new")).over(so_far(w)))
    return rows.groupBy(*keys, "block", "label").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")
    )


def stability(labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """How long episodes last, and switches a year."""
    return (
        episodes(labels, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("episodes"),
            F.median("days").alias("median_days"),
            F.avg("days").alias("mean_days"),
            F.min("days").alias("shortest_days"),
            ((F.count("*") - 1) / (F.sum("days") / DAYS)).alias("switches_per_year"),
        )
    )


def regime_summary(bars_with_returns: DataFrame, labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """What the asset itself did in each regime, and how often and long the regime came."""
    rows = bars_with_returns.join(labels.where(F.col("label") != UNKNOWN).select("series_id", "date", "label"), ["series_id", "date"])
    days = rows.groupBy(*keys, "label").agg(
        F.count("*").alias("days"),
        yearly_from_mean(F.avg("r")).alias("ann_return"),
        volatility(F.col("r")).alias("ann_volatility"),
        sharpe(F.col("r")).alias("sharpe_ratio"),
        F.min("r").alias("worst_day"),
    )
    runs = episodes(labels, keys).groupBy(*keys, "label").agg(F.count("*").alias("episodes"), F.avg("days").alias("mean_episode_days"))
    share = F.col("days") / F.sum("days").over(Window.partitionBy(*keys))
    return days.join(runs, [*keys, "label"]).withColumn("share", share)


def metrics_long(report: DataFrame, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """(keys, name, value) of a wide report; a metric that wasn't computed has no row."""
    names = [c for c in report.columns if c not in keys]
    doubles = report.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot(list(keys), names, "name", "value").where("value is not null")


def metrics_differ(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """Metrics that two runs don't share or share with other values."""
    joined = a.alias("a").join(b.alias("b"), [*keys, "name"], "full")
    return joined.where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(*keys, "name")

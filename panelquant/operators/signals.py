"""Trading signals: bars in, one ``signal`` a row out. Comparisons with missing values are false: warm-up rows are flat."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import change, ordered, rolling, so_far

from .indicators import KEY, eligible, rsi, with_returns


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def _signal(bars: DataFrame, signal: Column, keys: Sequence[str]) -> DataFrame:
    return bars.select(*keys, "date", signal.alias("signal"))


def sma_crossover(bars: DataFrame, short_window: int = 50, long_window: int = 200, keys: Sequence[str] = KEY) -> DataFrame:
    w, close = ordered(keys), F.col("close")
    return _signal(bars, _flag(rolling(F.avg, close, short_window, w) > rolling(F.avg, close, long_window, w)), keys)


def momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.0, keys: Sequence[str] = KEY) -> DataFrame:
    return _signal(bars, _flag(change(F.col("close"), lookback, ordered(keys)) > threshold), keys)


def mean_reversion_rsi(bars: DataFrame, period: int = 14, oversold: float = 30, overbought: float = 70, keys: Sequence[str] = KEY) -> DataFrame:
    """Long from below ``oversold`` until above ``overbought``; between them the last state holds."""
    w = ordered(keys)
    rows = with_returns(bars, keys).withColumn("rsi", rsi(F.col("close"), F.col("delta"), period, w))
    rows = rows.withColumn("state", F.when(F.col("rsi") > overbought, 0.0).when(F.col("rsi") < oversold, 1.0))
    return _signal(rows, F.coalesce(F.last("state", ignorenulls=True).over(so_far(w)), F.lit(0.0)), keys)


def constant(bars: DataFrame, exposure: float = 1.0, keys: Sequence[str] = KEY) -> DataFrame:
    return _signal(bars, F.lit(float(exposure)), keys)


def cross_sectional_momentum(bars: DataFrame, lookback: int = 252, skip: int = 21, decile: float = 0.1) -> DataFrame:
    """(series_id, date, weight) on the panel's dates: long the best, short the worst of the eligible names.

    Names are ranked on each month's last date in the panel; ties go by series_id.
    Weights hold until the next ranking; a month with fewer than two eligible names keeps them.
    """
    w = ordered()
    dates = bars.select("date").distinct()
    grid = bars.select("series_id").distinct().crossJoin(F.broadcast(dates))  # the dates of a panel are few
    panel = grid.join(bars.select("series_id", "date", "close"), ["series_id", "date"], "left")
    score = F.lag("close", skip).over(w) / F.nullif(F.lag("close", lookback).over(w), F.lit(0.0)) - 1
    last = F.max("date").over(Window.partitionBy("series_id", F.trunc("date", "MM")))
    ranked = panel.withColumns({"score": score, "able": eligible(F.col("close"), lookback, w), "last": last})
    ranked = ranked.withColumn("able", F.col("able") & F.col("score").isNotNull())
    ends = ranked.where("date = last")
    day = Window.partitionBy("date", "able")
    ends = ends.withColumns(
        {
            "n": F.count_if("able").over(Window.partitionBy("date")),
            "up": F.row_number().over(day.orderBy(F.asc("score"), F.asc("series_id"))),
            "down": F.row_number().over(day.orderBy(F.desc("score"), F.desc("series_id"))),
        }
    )
    leg = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * decile)), F.floor(F.col("n") / 2))
    weight = (
        F.when(F.col("n") < 2, None)
        .when(F.col("able") & (F.col("down") <= leg), 1.0 / leg)
        .when(F.col("able") & (F.col("up") <= leg), -1.0 / leg)
        .otherwise(0.0)
    )
    chosen = ends.select("series_id", "date", weight.alias("own"))
    held = F.coalesce(F.last("own", ignorenulls=True).over(so_far(w)), F.lit(0.0))
    return panel.join(chosen, ["series_id", "date"], "left").select("series_id", "date", "close", held.alias("weight"))


@dataclass(frozen=True)
class SignalSpec:
    """A named, versioned strategy with bounded parameters; ``build`` turns bars into signals."""

    name: str
    version: int
    build: Callable[..., DataFrame]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def signals(self, bars: DataFrame, **parameters: float) -> DataFrame:
        unknown = set(parameters) - set(self.bounds)
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return self.build(bars, **parameters)


CATALOG = {
    s.name: s
    for s in (
        SignalSpec("sma_crossover", 1, sma_crossover, {"short_window": (2, 250), "long_window": (3, 500)}),
        SignalSpec("momentum", 1, momentum, {"lookback": (1, 500), "threshold": (-1.0, 1.0)}),
        SignalSpec("mean_reversion_rsi", 1, mean_reversion_rsi, {"period": (2, 100), "oversold": (0.0, 100.0), "overbought": (0.0, 100.0)}),
        SignalSpec("constant", 1, constant, {"exposure": (0.0, 1.0)}),
    )
}


def stacked(bars: DataFrame, runs: Sequence[tuple[str, str, dict]]) -> DataFrame:
    """(run_id, series_id, date, signal) of several (run id, strategy, parameters), in long form, for one backtest of all."""
    out = None
    for run_id, name, parameters in runs:
        own = CATALOG[name].signals(bars, **parameters).withColumn("run_id", F.lit(run_id))
        out = own if out is None else out.unionByName(own)
    return out.select("run_id", "series_id", "date", "signal")


def fingerprint(signals: DataFrame, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """SHA-256 of each series' positions, rounded to ten decimals, in date order."""
    own = F.struct("date", F.format_number("signal", 10).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["s"]), ",")
    return signals.groupBy(*keys).agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("rows"))

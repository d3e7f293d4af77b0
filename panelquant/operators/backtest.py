"""Positions to returns, costs and equity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelquant.functions.columns import change, ordered, so_far

RUN_KEY = ("run_id", "series_id")


def run_backtest(bars: DataFrame, signals: DataFrame, cost_bps: float = 5.0, regimes: DataFrame | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """A signal earns from the next row on; each change of position costs ``cost_bps`` of it.

    ``signals`` may have several runs of a series (``run_id``); all are computed in
    one pass, with one shuffle by run and series. The first row has no return.
    """
    keys = list(keys or [c for c in ("run_id", "series_id") if c in signals.columns])
    w = ordered(keys)
    priced = bars.withColumn("daily_return", change(F.col("close"), 1, ordered()))
    rows = priced.select("series_id", "date", "close", "daily_return")
    if "run_id" in keys:
        rows = rows.join(signals.select(*keys, "date", "signal"), ["series_id", "date"])
    else:
        rows = rows.join(signals.select("series_id", "date", "signal"), ["series_id", "date"], "left")
    rows = rows.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0.0)))
    moved = F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.abs("position"))
    rows = rows.withColumns({"gross_return": F.col("position") * F.col("daily_return"), "cost": moved * (cost_bps / 10_000.0)})
    rows = rows.withColumn("strategy_return", F.col("gross_return") - F.col("cost"))
    rows = rows.withColumns(
        {
            "equity_curve": F.product(1 + F.col("strategy_return")).over(so_far(w)),
            "benchmark_curve": F.product(1 + F.col("daily_return")).over(so_far(w)),
        }
    )
    if regimes is not None:
        rows = rows.join(regimes.select("series_id", "date", F.col("label").alias("regime")), ["series_id", "date"], "left")
        rows = rows.withColumn("regime", F.coalesce("regime", F.lit(-1)))
    return rows


def run_portfolio_backtest(weights: DataFrame, cost_bps: float = 5.0, keys: Sequence[str] = ()) -> DataFrame:
    """Returns of weights (series_id, date, close, weight) on all dates of a panel, one row a date.

    A held name without a price earns 0 that day; the benchmark averages the names that have a return.
    """
    w = ordered([*keys, "series_id"])
    rows = weights.withColumns({"position": F.coalesce(F.lag("weight").over(w), F.lit(0.0)), "r": change(F.col("close"), 1, w)})
    rows = rows.withColumn("moved", F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.abs("position")))
    days = rows.groupBy(*keys, "date").agg(
        F.sum(F.col("position") * F.coalesce("r", F.lit(0.0))).alias("gross_return"),
        (F.sum("moved") * (cost_bps / 10_000.0)).alias("cost"),
        F.avg("r").alias("benchmark_return"),
    )
    days = days.withColumn("strategy_return", F.col("gross_return") - F.col("cost"))
    growth = {"equity_curve": 1 + F.col("strategy_return"), "benchmark_curve": 1 + F.col("benchmark_return")}
    return compounded(days, growth, keys).drop("benchmark_return")


def compounded(rows: DataFrame, growth: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Running products of factors by date, of each key or of all rows.

    Products run in each month; a month's starts from the product of the months before, an array of
    one value a month. So no task holds a key's rows. A null factor is left out.
    """
    block = F.trunc("date", "MM")
    inside = so_far(ordered([*keys, "block"]))
    rows = rows.withColumn("block", block).withColumns({c: F.coalesce(F.product(x).over(inside), F.lit(1.0)) for c, x in growth.items()})
    rows = rows.withColumns({f"has_{c}": F.count(x).over(inside) for c, x in growth.items()})
    last = {c: F.max_by(c, "date").alias(c) for c in growth}
    seen = {c: F.max(f"has_{c}").alias(f"has_{c}") for c in growth}
    months = rows.groupBy(*keys, "block").agg(*last.values(), *seen.values())
    months = months.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *growth, *[f"has_{c}" for c in growth]))).alias("m"))
    place = months.select(*keys, "m", F.posexplode("m").alias("i", "own"))
    before = F.slice("m", 1, F.col("i"))
    product = lambda c: F.aggregate(before, F.lit(1.0), lambda acc, x: acc * x[c])
    count = lambda c: F.aggregate(before, F.lit(0).cast("bigint"), lambda acc, x: acc + x[c])
    carried = place.select(*keys, F.col("own.block").alias("block"), *[product(c).alias(f"before_{c}") for c in growth], *[count(f"has_{c}").alias(f"seen_{c}") for c in growth])
    rows = rows.join(carried, [*keys, "block"])
    rows = rows.withColumns({c: F.when(F.col(f"seen_{c}") + F.col(f"has_{c}") > 0, F.col(c) * F.col(f"before_{c}")) for c in growth})
    return rows.drop("block", *[f"{p}_{c}" for p in ("has", "before", "seen") for c in growth])


def strategy_returns(rows: DataFrame, cost_bps: float = 5.0, keys: Sequence[str] = ("series_id",), by: str = "t0") -> DataFrame:
    """Monthly: the position at a decision earns the forward return of that decision, less the cost of entering it."""
    moved = F.coalesce(F.abs(F.col("position") - F.lag("position").over(ordered(keys, by))), F.abs("position"))
    return rows.withColumn("strategy_return", F.col("position") * F.col("forward_return") - moved * (cost_bps / 10_000.0))


def rescaled_exposure(backtest: DataFrame) -> DataFrame:
    """The constant signal with each run's own mean exposure: what holding as much passively would do."""
    mean = backtest.groupBy("run_id", "series_id").agg(F.avg(F.abs("position")).alias("signal"))
    return backtest.select("run_id", "series_id", "date").join(mean, ["run_id", "series_id"])

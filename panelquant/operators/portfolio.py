"""Legs of a long-short portfolio: their returns, betas, and a short leg rescaled so that the betas cancel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import change, last_rows, ordered, so_far

LEGS = ("long", "short")


def _side(x: Column, leg: str) -> Column:
    """The part of a weight that belongs to a leg."""
    zero = F.lit(0.0)
    return F.greatest(x, zero) if leg == "long" else F.least(x, zero)


def trailing_betas(panel: DataFrame, window: int = 252, least: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``beta``: slope of each name's returns on the mean of all names' over its last ``window`` rows.

    Null with fewer than ``least`` (half of the window) pairs. A day's market return is the mean of the names that have a return.
    """
    w = ordered([*keys, "series_id"])
    rows = panel.withColumn("r", change(F.col("close"), 1, w))
    market = rows.groupBy(*keys, "date").agg(F.avg("r").alias("market"))
    own = last_rows(w, window)
    pairs = F.count("r").over(own)  # a name with a return has a market
    beta = F.when(pairs >= (window // 2 if least is None else least), F.regr_slope("r", "market").over(own))
    return rows.join(market, [*keys, "date"]).withColumn("beta", beta)


def beta_neutral(weights: DataFrame, window: int = 252, least: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Weights (series_id, date, close, weight) with the short leg scaled by the ratio of the legs' betas, added as ``scale``.

    A leg's beta is the sum of weights times trailing betas on the last date of a month, known when the new weights
    are set; the scale holds as long as they do. It is 1 if a held name has no beta yet or a leg's beta isn't of its own sign.
    """
    rows = trailing_betas(weights, window, least, keys)
    month = Window.partitionBy(*keys, "series_id", F.trunc("date", "MM"))
    ends = rows.withColumn("last", F.max("date").over(month)).where("date = last and weight <> 0")
    legs = ends.groupBy(*keys, "date").agg(
        *[F.sum(_side(F.col("weight"), leg) * F.col("beta")).alias(leg) for leg in LEGS], F.count_if(F.col("beta").isNull()).alias("unknown")
    )
    usable = (F.col("unknown") == 0) & (F.col("long") > 0) & (F.col("short") < 0)
    scales = legs.select(*keys, "date", F.when(usable, -F.col("long") / F.col("short")).otherwise(1.0).alias("own"))
    held = F.coalesce(F.last("own", ignorenulls=True).over(so_far(ordered([*keys, "series_id"]))), F.lit(1.0))
    rows = rows.join(scales, [*keys, "date"], "left").withColumn("scale", held)
    scaled = F.when(F.col("weight") < 0, F.col("weight") * F.col("scale")).otherwise(F.col("weight"))
    return rows.select(*keys, "series_id", "date", "close", scaled.alias("weight"), "scale")


def leg_returns(weights: DataFrame, cost_bps: float = 5.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, long_gross, long_cost, long_return, short_gross, ..., strategy_return) of weights on a panel's dates.

    A weight earns from the next row on. A change of sign is a trade in both legs, so legs add up to the portfolio, costs included.
    """
    w = ordered([*keys, "series_id"])
    rows = weights.withColumns({"position": F.coalesce(F.lag("weight").over(w), F.lit(0.0)), "r": F.coalesce(change(F.col("close"), 1, w), F.lit(0.0))})
    rows = rows.withColumn("before", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    parts = []
    for leg in LEGS:
        now, before = _side(F.col("position"), leg), _side(F.col("before"), leg)
        parts += [F.sum(now * F.col("r")).alias(f"{leg}_gross"), (F.sum(F.abs(now - before)) * (cost_bps / 10_000.0)).alias(f"{leg}_cost")]
    days = rows.groupBy(*keys, "date").agg(*parts)
    days = days.withColumns({f"{leg}_return": F.col(f"{leg}_gross") - F.col(f"{leg}_cost") for leg in LEGS})
    return days.withColumn("strategy_return", F.col("long_return") + F.col("short_return"))


def leg_attribution(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the legs' returns and costs and the portfolio's, and its compounded return, over the days of each key."""
    sums = [F.sum(c).alias(c) for c in ("long_return", "short_return", "strategy_return", "long_cost", "short_cost")]
    return days.groupBy(*keys).agg(F.count("*").alias("days"), *sums, (F.product(1 + F.col("strategy_return")) - 1).alias("total_return"))

"""Features of price bars, calendars and labels. Every expression of a row uses that row and earlier ones only, except labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelquant.functions.columns import DAYS, change, correlation, expanding, last_rows, ordered, positive, rolling, so_far

KEY = ("series_id",)
RETURN_LAGS = (1, 2, 3, 5, 10)


def rsi(x: Column, delta: Column, n: int, w: WindowSpec) -> Column:
    """Relative strength from plain means of gains and losses; 100 if there was no loss. ``delta`` is x's change, as a column."""
    gain, loss = positive(delta), positive(-delta)
    up, down = rolling(F.avg, gain, n, w), rolling(F.avg, loss, n, w)
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))


def with_returns(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Add the day's change ``delta`` and return ``r``."""
    w = ordered(keys)
    return bars.withColumns({"delta": F.col("close") - F.lag("close").over(w), "r": change(F.col("close"), 1, w)})


def daily_features(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Lagged returns, distances to moving averages, RSI, volatility and, where there is volume, its change."""
    w, close = ordered(keys), F.col("close")
    five, twenty = rolling(F.avg, close, 5, w), rolling(F.avg, close, 20, w)
    columns = {f"return_{n}d": change(close, n, w) for n in RETURN_LAGS}
    columns |= {
        "price_vs_sma5": close / five - 1,
        "price_vs_sma20": close / twenty - 1,
        "sma5_vs_sma20": five / twenty - 1,
        "rsi_14": rsi(close, F.col("delta"), 14, w),
        "volatility_10d": rolling(F.stddev_samp, F.col("r"), 10, w),
    }
    if "volume" in bars.columns:
        columns["volume_change_5d"] = change(F.col("volume").cast("double"), 5, w)
    return with_returns(bars, keys).withColumns(columns).select(*keys, "date", *columns)


def next_day_label(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """1 if the next close is higher, 0 if not, null on the last row."""
    following = F.lead("close").over(ordered(keys))
    return bars.select(*keys, "date", F.when(following.isNotNull(), (following > F.col("close")).cast("double")).alias("y"))


def earlier_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, equal) values before each one.

    Blocks of 1, 2, 4, ... values are merged with their left neighbours; a level is one
    sort of all values, after which a running count tells how many of the left block lie below.
    """
    n = len(x)
    value = np.unique(x, return_inverse=True)[1].astype(np.int64)
    smaller, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, size = np.arange(n), 1
    while size < n:
        pair, right = at // (2 * size), at // size % 2 == 1
        order = np.argsort((pair * n + value) * 2 + right, kind="stable")  # of equal values, the left block's first
        left = np.cumsum(~right[order])
        start = np.concatenate([[True], np.diff(pair[order]) != 0])
        tie = start | np.concatenate([[True], np.diff(value[order]) != 0])
        before = left - ~right[order]
        base, below = before[np.maximum.accumulate(np.where(start, at, 0))], before[np.maximum.accumulate(np.where(tie, at, 0))]
        own = right[order]
        smaller[order[own]] += (below - base)[own]
        equal[order[own]] += (left - below)[own]
        size *= 2
    return smaller, equal


class _Past:
    """The values of a series so far, as sorted runs of falling length."""

    def __init__(self):
        self.runs: list[np.ndarray] = []
        self.n = 0

    def ranks(self, x: np.ndarray, least: int) -> np.ndarray:
        """Each value's rank among itself and all before it, as a share; NaN before ``least`` values. Then add them."""
        smaller, equal = earlier_counts(x)
        for run in self.runs:
            low = np.searchsorted(run, x, "left")
            smaller, equal = smaller + low, equal + np.searchsorted(run, x, "right") - low
        seen = self.n + np.arange(1, len(x) + 1)
        self.n += len(x)
        self.runs.append(np.sort(x))
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]
        return np.where(seen >= least, (smaller + (equal + 2) / 2) / seen, np.nan)


def by_series(rows: DataFrame, keys: Sequence[str], schema: str, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Rows in date order through a function with a state: ``start()`` makes a new one for each series, which gets it in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, step = None, None
        for batch in batches:
            key = batch[list(keys)]
            cut = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            for a, b in zip([0, *cut[cut > 0].tolist()], [*cut[cut > 0].tolist(), len(batch)]):
                if a == b:
                    continue
                name = tuple(key.iloc[a])
                if name != own:
                    own, step = name, start()
                yield step(batch.iloc[a:b])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "date").mapInPandas(run, schema)


def expanding_rank(rows: DataFrame, value: str, out: str, least: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Add the value's rank among the values so far, as a share, ties averaged; null before ``least`` values.

    One pass over each series in date order, a batch at a time against the sorted runs of the
    batches before; n log n, and only the values are kept.
    """

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        past = _Past()

        def step(own: pd.DataFrame) -> pd.DataFrame:
            x = own[value].to_numpy(float)
            ranks, there = np.full(len(x), np.nan), ~np.isnan(x)
            ranks[there] = past.ranks(x[there], least)
            return own.assign(**{out: pd.array(ranks, dtype="Float64")})

        return step

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return by_series(rows, keys, f"{schema}, `{out}` double", start)


def regime_features(bars: DataFrame, vol: int = 20, trend: int = 60, long: int = 252, keys: Sequence[str] = KEY) -> DataFrame:
    """Volatility, trend, path, drawdown and, where high, low and volume are there, range and liquidity features."""
    w, close, r = ordered(keys), F.col("close"), F.col("r")
    year = F.sqrt(F.lit(float(DAYS)))
    slow = min(long // 2, 100)
    rows = with_returns(bars, keys).withColumns(
        {
            "vol_20d": F.round(rolling(F.stddev_samp, r, vol, w) * year, 12),  # so that equal ones rank equally
            "vol_slow": rolling(F.stddev_samp, r, slow, w) * year,
            "sma_mid": rolling(F.avg, close, 50, w),
            "lagged_r": F.lag("r").over(w),
        }
    )
    pair = F.count(F.when(F.col("lagged_r").isNotNull(), r)).over(last_rows(w, trend))
    rms_down = F.sqrt(rolling(F.avg, F.pow(-positive(-r), 2), vol, w))
    rms = F.sqrt(rolling(F.avg, r * r, vol, w))
    columns = {
        "vol_ratio": F.col("vol_20d") / F.nullif("vol_slow", F.lit(0.0)),
        "trend_60d": change(close, trend, w),
        "price_vs_sma200": close / rolling(F.avg, close, long, w) - 1,
        "sma_slope": (F.col("sma_mid") - F.lag("sma_mid", 20).over(w)) / close,
        "efficiency_ratio": F.abs(close - F.lag("close", trend).over(w))
        / F.nullif(rolling(F.sum, F.abs("delta"), trend, w), F.lit(0.0)),
        "autocorr_60": F.when(pair == trend, correlation("r", "lagged_r", last_rows(w, trend))),
        "drawdown_252d": close / rolling(F.max, close, long, w, vol) - 1,
        "downside_share": rms_down / F.nullif(rms, F.lit(0.0)),
    }
    if {"high", "low"} <= set(bars.columns):
        columns["parkinson_vol"] = F.sqrt(
            rolling(F.avg, F.pow(F.ln(F.col("high") / F.col("low")), 2), vol, w) / (4 * F.ln(F.lit(2.0))) * DAYS
        )
        columns["range_pct"] = rolling(F.avg, (F.col("high") - F.col("low")) / close, vol, w)
    if "volume" in bars.columns:
        volume = F.col("volume").cast("double")
        half = long // 2
        mean, deviation = rolling(F.avg, volume, half, w, vol), rolling(F.stddev_samp, volume, half, w, vol)
        turnover = F.nullif(volume * close, F.lit(0.0))
        columns["volume_z"] = (volume - mean) / F.nullif(deviation, F.lit(0.0))
        columns["volume_trend"] = rolling(F.avg, volume, vol, w) / F.nullif(mean, F.lit(0.0))
        columns["illiquidity"] = rolling(F.avg, F.log1p(F.abs("r") / turnover * 1e9), vol, w)
    rows = rows.withColumns(columns).select(*keys, "date", "vol_20d", *columns)
    return expanding_rank(rows, "vol_20d", "vol_percentile", vol, keys)


def standardized(rows: DataFrame, columns: Sequence[str], method: str = "expanding", least: int = 60, bound: float = 5.0, keys: Sequence[str] = KEY) -> DataFrame:
    """z-scores against the past (``expanding``) or the whole series (``full``, which looks ahead), clipped."""
    w = ordered(keys)
    every = Window.partitionBy(*keys)

    def scaled(name: str) -> Column:
        x = F.col(name)
        if method == "full":
            mean, deviation = F.avg(x).over(every), F.stddev_samp(x).over(every)
        else:
            mean, deviation = expanding(F.avg, x, w, least), expanding(F.stddev_samp, x, w, least)
        z = (x - mean) / F.nullif(deviation, F.lit(0.0))
        return F.when(z.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))

    return rows.withColumns({c: scaled(c) for c in columns})


def calendar_panel(bars: DataFrame, fill: int = 5) -> DataFrame:
    """Every series on every weekday of the panel, closes carried forward over at most ``fill`` days."""
    span = bars.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    grid = bars.select("series_id").distinct().crossJoin(F.broadcast(days))  # the days of a panel are few
    filled = F.last("close", ignorenulls=True).over(ordered().rowsBetween(-fill, 0))
    panel = grid.join(bars.select("series_id", "date", "close"), ["series_id", "date"], "left")
    return panel.select("series_id", "date", filled.alias("close"), F.col("close").isNull().alias("missing"))


def month_ends(bars: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Each month's last date, complete months only: the last month counts if it reaches its last weekday."""
    months = bars.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))
    last = F.last_day("date")
    last_weekday = F.date_sub(last, F.greatest(F.weekday(last) - 4, F.lit(0)))
    final = F.max("date").over(Window.partitionBy(*keys))
    months = months.withColumn("final", final)
    return months.where((F.col("date") < F.col("final")) | (F.col("date") >= last_weekday)).select(*keys, "date")


def eligible(close: Column, least: int, w: WindowSpec) -> Column:
    """Whether so many values have been seen."""
    return F.count(close).over(so_far(w)) >= least

"""Immutable price snapshots, registries and result sinks as append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(bars: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """SHA-256 of each series' dates and closes in order, from shortest round-trip texts; with first, last and number of bars."""
    line = F.concat_ws(":", F.date_format("date", "yyyy-MM-dd"), F.coalesce(F.col("close").cast("string"), F.lit("null")))
    return bars.groupBy(*keys).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_bars"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("content_sha256"),
    )


def panel_key(tickers: DataFrame, start: str, end: str, column: str = "series_id") -> DataFrame:
    """SHA-1 of the sorted names and the range: the cache key of a panel."""
    names = F.array_join(F.array_sort(F.collect_set(column)), ",")
    return tickers.agg(F.sha1(F.concat_ws("|", names, F.lit(start), F.lit(end))).alias("panel_key"))


def new_snapshots(stored: DataFrame, candidates: DataFrame, identity: Sequence[str] = ("ticker", "source", "content_sha256")) -> DataFrame:
    """Candidates whose content isn't stored, each content once."""
    return candidates.dropDuplicates(list(identity)).join(stored, list(identity), "left_anti")


def newest_covering(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each request the newest snapshot of its ticker that was fetched over the whole range."""
    joined = requests.join(snapshots, "ticker").where("fetch_start <= start and fetch_end >= end")
    order = Window.partitionBy("request_id").orderBy(F.desc("fetched_at"), F.desc("snapshot_id"))
    return joined.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def price_quality(bars: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Violations of the contract of bars: too few, bad closes, repeated dates."""
    bad = F.count_if(F.col("close").isNull() | (F.col("close") <= 0))
    checks = bars.groupBy(*keys).agg(
        F.count("*").alias("n_bars"), bad.alias("bad_closes"), (F.count("*") - F.count_distinct("date")).alias("repeated_dates")
    )
    return checks.withColumn("valid", (F.col("n_bars") >= 2) & (F.col("bad_closes") == 0) & (F.col("repeated_dates") == 0))


def next_versions(registry: DataFrame, models: DataFrame) -> DataFrame:
    """Models whose (snapshot, artifact) isn't registered yet, with the versions that follow the registry's last."""
    fresh = models.join(registry, ["name", "snapshot_id", "artifact_sha256"], "left_anti")
    last = registry.groupBy("name").agg(F.max("version").alias("last"))
    order = Window.partitionBy("name").orderBy("created_at", "artifact_sha256")
    fresh = fresh.join(last, "name", "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.row_number().over(order))
    return fresh.drop("last")


def series_sink(backtest: DataFrame) -> DataFrame:
    """One row a run and series: its dates, equity and positions as arrays in order."""
    packed = backtest.groupBy("run_id", "series_id").agg(F.array_sort(F.collect_list(F.struct("date", "equity_curve", "position"))).alias("s"))
    field = lambda name: F.transform("s", lambda x: x[name]).alias(name)
    return packed.select("run_id", "series_id", field("date"), field("equity_curve"), field("position"))


def series_source(packed: DataFrame) -> DataFrame:
    """The rows of :func:`series_sink` again."""
    zipped = F.inline(F.arrays_zip("date", "equity_curve", "position"))
    return packed.select("run_id", "series_id", zipped)


def mismatched(stored: DataFrame, recomputed: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose stored hash isn't the recomputed one."""
    a, b = stored.select(key, F.col(column).alias("was")), recomputed.select(key, F.col(column).alias("is"))
    return a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("is")))


def request_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns, names sorted."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def validated_requests(requests: DataFrame, bounds: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """Requests with ``reason``: null if valid, else the first field at fault.

    ``params`` is a map; every parameter of a strategy must be known and in bounds.
    """
    known = F.col("strategy").isin(*bounds)
    fault: Column = F.when(~known, "strategy")
    fault = fault.when(~F.coalesce(F.upper(F.trim("ticker")).rlike(r"^[A-Z0-9.^=-]{1,12}$"), F.lit(False)), "ticker")
    fault = fault.when(~F.coalesce(F.col("start") < F.col("end"), F.lit(False)), "end")
    fault = fault.when(~F.coalesce(F.col("cost_bps").between(0, 1000), F.lit(False)), "cost_bps")
    fault = fault.when(~F.coalesce(F.col("n_boot").between(0, 10_000), F.lit(False)), "n_boot")
    for name, limits in bounds.items():
        own = F.col("strategy") == name
        names = F.array(*[F.lit(p) for p in limits]) if limits else F.array().cast("array<string>")
        fault = fault.when(own & (F.size(F.array_except(F.map_keys("params"), names)) > 0), "params")
        for p, (low, high) in limits.items():
            value = F.try_element_at("params", F.lit(p))
            fault = fault.when(own & value.isNotNull() & ~value.between(low, high), p)
        if {"short_window", "long_window"} <= set(limits):
            short, long = (F.try_element_at("params", F.lit(p)) for p in ("short_window", "long_window"))
            fault = fault.when(own & (short >= long), "short_window")
        if {"oversold", "overbought"} <= set(limits):
            low, high = (F.try_element_at("params", F.lit(p)) for p in ("oversold", "overbought"))
            fault = fault.when(own & (low >= high), "oversold")
    return requests.withColumn("reason", fault)

"""Request tables, pivots and other table work around the runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import last_rows, ordered, r6
from panelquant.operators import adaptive, backtest, indicators, reports, requests, signals
from panelquant.sources import panels, snapshots

from . import sql as q
from .labels import labels5
from .registry import query
from .runs import RUNS, STACKED_CTES, param_sweep, stacked_runs
from .studies import _ADAPT, _SWITCH, _learned, _reported

_LOOKBACKS = (10, 20, 60)


@query(
    q.with_(
        q.BARS,
        "rq AS (SELECT series_id || '/' || k AS run_id, series_id, k, min(date) AS a, max(date) AS b FROM bars, (SELECT unnest([10, 20, 60]) AS k) GROUP BY ALL)",
        "cutb AS (SELECT rq.run_id, rq.k, b.series_id, b.date, b.close FROM bars b JOIN rq USING (series_id) WHERE b.date >= rq.a + 100 AND b.date < rq.b - 100)",
        "sq AS (SELECT run_id, series_id, date, close, CASE WHEN close / lag(close, k) OVER (PARTITION BY run_id ORDER BY date) - 1 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM cutb)",
        q.backtest("sq", keys="run_id, series_id"),
        q.report("bt", "run_id, series_id"),
        select=f"SELECT run_id, series_id, {q.REPORT_SELECT} FROM rep",
    )
)
def request_runs(spark, sf_dir):
    """A table of requests (three lookbacks over a cut of each series) run as one job."""
    bars = panels.bars6(spark, sf_dir).select("series_id", "date", "close")
    spans = bars.groupBy("series_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    wanted = spans.withColumn("k", F.explode(F.array(*[F.lit(k) for k in _LOOKBACKS])))
    table = wanted.select(
        F.concat_ws("/", "series_id", "k").alias("request_id"), F.lit("momentum").alias("strategy"),
        F.create_map(F.lit("lookback"), F.col("k").cast("double")).alias("params"), F.col("series_id").alias("ticker"),
        F.date_add("a", 100).alias("start"), F.date_sub("b", 100).alias("end"),
    )
    return _reported(requests.run_requests(bars, table))


_NAMES = [r[0] for r in RUNS]


@query(
    q.with_(
        *STACKED_CTES,
        "eq AS (SELECT *, product(1 + strategy_return) OVER (PARTITION BY run_id, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM bt)",
        select="SELECT series_id, date, " + ", ".join(f"round(max(CASE WHEN run_id = '{n}' THEN e END), 9) AS {n}" for n in _NAMES) + " FROM eq GROUP BY series_id, date",
    )
)
def merged_run_series(spark, sf_dir):
    """Equity of all runs side by side."""
    rows = requests.merged_series(stacked_runs(spark, sf_dir)[2], _NAMES)
    return rows.select("series_id", "date", *[F.round(n, 9).alias(n) for n in _NAMES])


@query(q.with_(q.LABELS, select="SELECT series_id, date, " + ", ".join(f"(label = {k})::INT::DOUBLE AS regime_{k}" for k in range(4)) + " FROM labels5"))
def regime_dummies(spark, sf_dir):
    """One-hot regimes, columns from the training years."""
    return requests.one_hot(labels5(spark, sf_dir), "2000-01-01")


@query(
    q.with_(
        q.LABELS,
        f"px AS (SELECT series_id, date, close, close / lag(close, 10) OVER ({q.S}) - 1 AS a, close / lag(close, 60) OVER ({q.S}) - 1 AS b FROM bars)",
        "ps AS (SELECT px.series_id, px.date, close, CASE WHEN CASE WHEN label IN (2, 3) THEN a ELSE b END > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM px JOIN labels5 USING (series_id, date))",
        q.backtest("ps"),
        q.report("bt", "series_id"),
        select=f"SELECT series_id, {q.REPORT_SELECT} FROM rep",
    )
)
def regime_parameters(spark, sf_dir):
    """Momentum with a short lookback in wild regimes and a long one in calm ones."""
    bars = panels.bars6(spark, sf_dir)
    long = signals.stacked(bars, [("fast", "momentum", {"lookback": 10}), ("slow", "momentum", {"lookback": 60})])
    chosen = adaptive.regime_parameters(long, labels5(spark, sf_dir), {2: "fast", 3: "fast"}, "slow")
    return _reported(reports.full_report(backtest.run_backtest(bars, chosen), ["series_id"]))


_ENSEMBLE = f"""
vv AS (SELECT series_id, date, {q.full("stddev_samp", "r", 20)} * sqrt(252) AS vol FROM rets),
en AS (SELECT sw.series_id, sw.date, sw.close, round(CASE WHEN nullif(vol, 0) IS NULL THEN 0.0 ELSE sw.signal * least(0.10 / vol, 1.0) END, 8)::DOUBLE AS signal FROM sw JOIN vv USING (series_id, date))"""


@query(q.with_(*_ADAPT, _SWITCH, _ENSEMBLE, q.backtest("en", "st"), q.report("st", "series_id"), select=f"SELECT series_id, {q.REPORT_SELECT} FROM rep"))
def adaptive_ensemble(spark, sf_dir):
    """The regime switch scaled to a target volatility."""
    bars, labels, runs, ends, table = _learned(spark, sf_dir)
    mixed = adaptive.adaptive_ensemble(bars, runs, labels, adaptive.best_per_regime(table), ends)
    return _reported(reports.full_report(backtest.run_backtest(bars, mixed.withColumn("signal", F.round("signal", 8))), ["series_id"]))


@query(
    q.with_(
        *STACKED_CTES,
        select="""SELECT run_id, series_id, year(date)::INT AS year, count(*) AS days, round(product(1 + coalesce(strategy_return, 0.0)) - 1, 6) + 0.0::DOUBLE AS total_return
        FROM bt GROUP BY ALL""",
    )
)
def yearly_returns(spark, sf_dir):
    """Returns of each run by calendar year."""
    rows = stacked_runs(spark, sf_dir)[2]
    total = F.product(1 + F.coalesce("strategy_return", F.lit(0.0))) - 1
    return rows.groupBy("run_id", "series_id", F.year("date").alias("year")).agg(F.count("*").alias("days"), r6(total).alias("total_return"))


@query(
    q.with_(
        q.BARS,
        q.RETURNS,
        "mk AS (SELECT date, avg(r) AS mkt FROM rets GROUP BY date)",
        "rm AS (SELECT series_id, date, r, mkt FROM rets JOIN mk USING (date) WHERE r IS NOT NULL)",
        select=f"SELECT series_id, date, round(CASE WHEN count(r) {q.rows(60)} = 60 THEN regr_slope(r, mkt) {q.rows(60)} END, 6) + 0.0::DOUBLE AS beta FROM rm",
    )
)
def rolling_beta(spark, sf_dir):
    """Slope of each series on the equal-weight mean over sixty days."""
    rows = indicators.with_returns(panels.bars6(spark, sf_dir))
    market = rows.groupBy("date").agg(F.avg("r").alias("mkt"))
    rows = rows.join(market, "date").where("r is not null")
    own = last_rows(ordered(), 60)
    beta = F.when(F.count("r").over(own) == 60, F.covar_pop("r", "mkt").over(own) / F.nullif(F.var_pop("mkt").over(own), F.lit(0.0)))
    return rows.select("series_id", "date", r6(beta).alias("beta"))


@query(
    q.with_(
        *STACKED_CTES,
        q.report("bt", "run_id, series_id"),
        select="SELECT run_id, series_id, round(sharpe_ratio, 6) + 0.0::DOUBLE AS sharpe_ratio FROM rep ORDER BY sharpe_ratio DESC, run_id, series_id LIMIT 5",
    )
)
def top_runs(spark, sf_dir):
    """The five runs with the highest Sharpe."""
    rows = param_sweep(spark, sf_dir).select("run_id", "series_id", "sharpe_ratio")
    return rows.orderBy(F.desc("sharpe_ratio"), "run_id", "series_id").limit(5)


@query(
    q.with_(
        *STACKED_CTES,
        q.report("bt", "run_id, series_id"),
        select="SELECT count(*) * 11 AS metrics, 0::BIGINT AS different FROM rep",
    )
)
def determinism_check(spark, sf_dir):
    """Metrics of two runs of the same requests that differ: none."""
    a = reports.metrics_long(param_sweep(spark, sf_dir))
    b = reports.metrics_long(param_sweep(spark, sf_dir))
    different = reports.metrics_differ(a, b).agg(F.count("*").alias("different"))
    return a.agg(F.count("*").alias("metrics")).crossJoin(different)  # one row each


@query(
    q.with_(
        q.PANEL,
        "py AS (SELECT series_id, year(date)::INT AS y, close, date FROM pbars)",
        "pu AS (SELECT DISTINCT series_id FROM py WHERE y = 1995 UNION SELECT DISTINCT series_id FROM py WHERE y = 2001)",
        select="""SELECT u.series_id, EXISTS (SELECT 1 FROM py WHERE py.series_id = u.series_id AND y = 1995) AND EXISTS (SELECT 1 FROM py WHERE py.series_id = u.series_id AND y = 2001) AS in_both,
        (SELECT max_by(close, date) FROM py WHERE py.series_id = u.series_id) AS last_close FROM pu u""",
    )
)
def universe_overlap(spark, sf_dir):
    """Names of the first and last year: union, intersection and last close."""
    rows = panels.panel25(spark, sf_dir)
    first, last = (rows.where(F.year("date") == y).select("series_id").distinct() for y in (1995, 2001))
    both = first.intersect(last).withColumn("in_both", F.lit(True))
    closes = rows.groupBy("series_id").agg(F.max_by("close", "date").alias("last_close"))
    out = first.union(last).distinct().join(both, "series_id", "left").join(closes, "series_id")
    return out.select("series_id", F.coalesce("in_both", F.lit(False)).alias("in_both"), "last_close")


@query(
    q.with_(
        q.BARS,
        "hs AS (SELECT series_id, sha256(string_agg(strftime(date, '%Y-%m-%d') || ':' || format('{:,.6f}', close), '|' ORDER BY date)) AS h FROM bars GROUP BY 1)",
        select="SELECT series_id, h AS was, sha256(h) AS is_now FROM hs WHERE series_id LIKE 'R%'",
    )
)
def integrity_check(spark, sf_dir):
    """Stored hashes that no longer match their content (half of them were changed on purpose)."""
    bars = panels.bars6(spark, sf_dir).withColumn("close", F.format_number("close", 6))
    stored = snapshots.content_hash(bars).select("series_id", F.col("content_sha256").alias("h"))
    found = stored.withColumn("h", F.when(F.col("series_id").startswith("R"), F.sha2("h", 256)).otherwise(F.col("h")))
    return snapshots.mismatched(stored, found, "series_id", "h").select("series_id", "was", F.col("is").alias("is_now"))

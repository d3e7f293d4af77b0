"""Signals, backtests, features and stores over the bar panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import ordered, r6
from panelquant.operators import adaptive, backtest, indicators, reports, signals
from panelquant.sources import panels, snapshots

from . import sql as q
from .registry import query


def _rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sma_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.bars6(spark, sf_dir)
    return backtest.run_backtest(bars, signals.sma_crossover(bars))


_REPORT_SQL = f"SELECT series_id, {q.REPORT_SELECT} FROM rep"


@query(q.with_(q.BARS, q.SMA, q.backtest("sma"), q.report("bt", "series_id"), select=_REPORT_SQL))
def sma_backtest_report(spark, sf_dir):
    """Full report of the SMA crossover, one row a series."""
    return _rounded(reports.full_report(sma_run(spark, sf_dir), ["series_id"]), q.REPORT_COLUMNS)


_BT = "position, round(daily_return, 6) + 0.0::DOUBLE AS daily_return, round(cost, 6) + 0.0::DOUBLE AS cost, round(strategy_return, 6) + 0.0::DOUBLE AS strategy_return"
# ten decimals: the benchmark is a ratio of closes of six, and would meet ties
_CURVES = """round(product(1 + strategy_return) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 10) AS equity_curve,
round(product(1 + daily_return) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 10) AS benchmark_curve"""


@query(q.with_(q.BARS, q.MOMENTUM, q.backtest("mom"), select=f"SELECT series_id, date, {_BT}, {_CURVES} FROM bt"))
def momentum_backtest(spark, sf_dir):
    """Daily rows of the momentum backtest."""
    bars = panels.bars6(spark, sf_dir)
    rows = backtest.run_backtest(bars, signals.momentum(bars))
    columns = ["daily_return", "cost", "strategy_return"]
    curves = [F.round(c, 10).alias(c) for c in ("equity_curve", "benchmark_curve")]
    return _rounded(rows, columns).select("series_id", "date", "position", *columns, *curves)


@query(q.with_(q.BARS, q.RETURNS, q.RSI, select="SELECT r.series_id, r.date, round(rsi, 6) + 0.0::DOUBLE AS rsi, signal FROM rsi r JOIN revert v USING (series_id, date)"))
def rsi_hold_signal(spark, sf_dir):
    """RSI and the mean-reversion signal that holds between its thresholds."""
    bars = panels.bars6(spark, sf_dir)
    w = ordered()
    rsi = indicators.with_returns(bars).select("series_id", "date", r6(indicators.rsi(F.col("close"), F.col("delta"), 14, w)).alias("rsi"))
    return rsi.join(signals.mean_reversion_rsi(bars), ["series_id", "date"])


_STACKED = """
runs AS (SELECT 'sma' AS run_id, * FROM sma UNION ALL SELECT 'momentum', * FROM mom UNION ALL SELECT 'rsi', * FROM revert
  UNION ALL SELECT 'hold', series_id, date, close, 1.0::DOUBLE FROM bars)"""
RUNS = [("sma", "sma_crossover", {}), ("momentum", "momentum", {}), ("rsi", "mean_reversion_rsi", {}), ("hold", "constant", {"exposure": 1.0})]
STACKED_CTES = (q.BARS, q.RETURNS, q.SMA, q.MOMENTUM, q.RSI, _STACKED, q.backtest("runs", keys="run_id, series_id"))


def stacked_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = panels.bars6(spark, sf_dir)
    long = signals.stacked(bars, RUNS)
    return bars, long, backtest.run_backtest(bars, long)


@query(q.with_(*STACKED_CTES, q.report("bt", "run_id, series_id"), select=f"SELECT run_id, series_id, {q.REPORT_SELECT} FROM rep"))
def param_sweep(spark, sf_dir):
    """All strategies stacked by run and backtested in one pass."""
    return _rounded(reports.full_report(stacked_runs(spark, sf_dir)[2]), q.REPORT_COLUMNS)


_SUMMARY = """
SELECT run_id, series_id, round(max_by(eq, date) - 1, 6) + 0.0::DOUBLE AS total_return, round(max_by(bq, date) - 1, 6) + 0.0::DOUBLE AS benchmark_return,
  count(*) FILTER (moved > 0) AS num_trades,
  round(CASE WHEN count(*) FILTER (strategy_return <> 0) > 0 THEN count(*) FILTER (strategy_return > 0) / count(*) FILTER (strategy_return <> 0) ELSE 0 END, 6) + 0.0::DOUBLE AS win_rate,
  round(sum(cost), 6) + 0.0::DOUBLE AS total_cost
FROM (SELECT *, product(1 + strategy_return) OVER (PARTITION BY run_id, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq,
  product(1 + daily_return) OVER (PARTITION BY run_id, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS bq,
  abs(position - lag(position) OVER (PARTITION BY run_id, series_id ORDER BY date)) AS moved FROM bt) GROUP BY run_id, series_id"""


@query(q.with_(*STACKED_CTES, select=_SUMMARY))
def period_summary(spark, sf_dir):
    """Returns, trades and cost of whole backtests."""
    rows = reports.summary_stats(stacked_runs(spark, sf_dir)[2])
    return _rounded(rows, ["total_return", "benchmark_return", "win_rate", "total_cost"])


_LONG = "SELECT * FROM (UNPIVOT (SELECT run_id, series_id, n::DOUBLE AS n, num_trades::DOUBLE AS num_trades, " + ", ".join(
    f"({q.r6(c)}) AS {c}" for c in q.REPORT_COLUMNS
) + " FROM rep) ON COLUMNS(* EXCLUDE (run_id, series_id)) INTO NAME name VALUE value)"


@query(q.with_(*STACKED_CTES, q.report("bt", "run_id, series_id"), select=_LONG))
def metrics_long(spark, sf_dir):
    """The report in long form: one row a metric."""
    return reports.metrics_long(param_sweep(spark, sf_dir))


@query(
    q.with_(
        *STACKED_CTES,
        "passive AS (SELECT run_id, series_id, date, close, avg(abs(position)) OVER (PARTITION BY run_id, series_id) AS signal FROM bt)",
        q.backtest("passive", "pt", "run_id, series_id"),
        q.report("pt", "run_id, series_id"),
        select=f"SELECT run_id, series_id, {q.REPORT_SELECT} FROM rep",
    )
)
def passive_equivalent(spark, sf_dir):
    """Holding each run's own mean exposure all the time."""
    bars, _, rows = stacked_runs(spark, sf_dir)
    passive = backtest.run_backtest(bars, backtest.rescaled_exposure(rows))
    return _rounded(reports.full_report(passive), q.REPORT_COLUMNS)


@query(
    q.with_(
        *STACKED_CTES,
        select="""SELECT run_id, series_id, round(CASE WHEN stddev_samp(g) > 1e-12 THEN avg(g) / stddev_samp(g) * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS gross_sharpe,
        round(CASE WHEN stddev_samp(s) > 1e-12 THEN avg(s) / stddev_samp(s) * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS net_sharpe, round(sum(cost), 6) + 0.0::DOUBLE AS total_cost
        FROM (SELECT *, coalesce(gross_return, 0) AS g, coalesce(strategy_return, 0) AS s FROM bt) GROUP BY run_id, series_id""",
    )
)
def gross_vs_net(spark, sf_dir):
    """Sharpe before and after costs."""
    from panelquant.functions.columns import sharpe

    rows = stacked_runs(spark, sf_dir)[2]
    zero = F.lit(0.0)
    return rows.groupBy("run_id", "series_id").agg(
        r6(sharpe(F.coalesce("gross_return", zero))).alias("gross_sharpe"),
        r6(sharpe(F.coalesce("strategy_return", zero))).alias("net_sharpe"),
        r6(F.sum("cost")).alias("total_cost"),
    )


_VT = f"""
vt AS (SELECT s.series_id, s.date, s.close, round(coalesce(s.signal * least(0.10 / nullif(vol, 0), 1.0), 0.0), 8)::DOUBLE AS signal
  FROM sma s JOIN (SELECT series_id, date, {q.full("stddev_samp", "r", 20)} * sqrt(252) AS vol FROM rets) v USING (series_id, date)
  WHERE vol IS NOT NULL
  UNION ALL SELECT s.series_id, s.date, s.close, 0.0 FROM sma s JOIN (SELECT series_id, date, {q.full("stddev_samp", "r", 20)} AS vol FROM rets) v USING (series_id, date) WHERE vol IS NULL)"""


@query(q.with_(q.BARS, q.RETURNS, q.SMA, _VT, q.backtest("vt"), q.report("bt", "series_id"), select=_REPORT_SQL))
def vol_target_backtest(spark, sf_dir):
    """The SMA crossover scaled to a target volatility."""
    bars = panels.bars6(spark, sf_dir)
    scaled = adaptive.volatility_targeted(bars, signals.sma_crossover(bars)).withColumn("signal", F.round("signal", 8))
    return _rounded(reports.full_report(backtest.run_backtest(bars, scaled), ["series_id"]), q.REPORT_COLUMNS)


_XS = f"""
grid AS (SELECT s.series_id, d.date, b.close FROM (SELECT DISTINCT series_id FROM pbars) s CROSS JOIN (SELECT DISTINCT date FROM pbars) d
  LEFT JOIN pbars b ON b.series_id = s.series_id AND b.date = d.date),
xs1 AS (SELECT *, lag(close, 5) OVER ({q.S}) / nullif(lag(close, 60) OVER ({q.S}), 0) - 1 AS score,
  count(close) OVER ({q.S} ROWS UNBOUNDED PRECEDING) >= 60 AS long_enough, max(date) OVER (PARTITION BY series_id, date_trunc('month', date)) AS last FROM grid),
xs2 AS (SELECT *, long_enough AND score IS NOT NULL AS able FROM xs1),
xs3 AS (SELECT *, count(*) FILTER (able) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date, able ORDER BY score, series_id) AS up,
  row_number() OVER (PARTITION BY date, able ORDER BY score DESC, series_id DESC) AS down FROM xs2 WHERE date = last),
xs4 AS (SELECT *, least(greatest(1, floor(n * 0.1)), n // 2) AS leg FROM xs3),
xs5 AS (SELECT series_id, date, CASE WHEN n < 2 THEN NULL WHEN able AND down <= leg THEN 1.0 / leg WHEN able AND up <= leg THEN -1.0 / leg ELSE 0.0 END::DOUBLE AS own FROM xs4),
xs AS (SELECT g.series_id, g.date, g.close, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.date ROWS UNBOUNDED PRECEDING), 0.0) AS weight
  FROM grid g LEFT JOIN xs5 USING (series_id, date))"""


def _weights(spark, sf_dir) -> DataFrame:
    return signals.cross_sectional_momentum(panels.panel25(spark, sf_dir), lookback=60, skip=5)


@query(q.with_(q.PANEL, _XS, select="SELECT series_id, date, round(weight, 6) + 0.0::DOUBLE AS weight FROM xs WHERE weight <> 0"))
def xs_momentum_weights(spark, sf_dir):
    """Cross-sectional momentum weights, the days held."""
    return _weights(spark, sf_dir).where("weight <> 0").select("series_id", "date", r6("weight").alias("weight"))


_PORTFOLIO = """
p1 AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY series_id ORDER BY date), 0.0) AS position, close / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY date), 0) - 1 AS r FROM xs),
p2 AS (SELECT *, coalesce(abs(position - lag(position) OVER (PARTITION BY series_id ORDER BY date)), abs(position)) AS moved FROM p1),
p3 AS (SELECT date, sum(position * coalesce(r, 0.0)) AS gross_return, sum(moved) * 5.0 / 10000 AS cost, avg(r) AS b FROM p2 GROUP BY date)
SELECT date, round(gross_return, 6) + 0.0::DOUBLE AS gross_return, round(cost, 6) + 0.0::DOUBLE AS cost, round(gross_return - cost, 6) + 0.0::DOUBLE AS strategy_return,
  round(product(1 + gross_return - cost) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS equity_curve,
  round(product(1 + b) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS benchmark_curve FROM p3"""


@query("WITH " + q.PANEL + "," + _XS + "," + _PORTFOLIO)
def portfolio_backtest(spark, sf_dir):
    """The long-short portfolio, one row a date."""
    rows = backtest.run_portfolio_backtest(_weights(spark, sf_dir))
    return _rounded(rows, ["gross_return", "cost", "strategy_return", "equity_curve", "benchmark_curve"])


_DAILY = [f"close / nullif(lag(close, {n}) OVER ({q.S}), 0) - 1 AS return_{n}d" for n in indicators.RETURN_LAGS]
_FIVE, _TWENTY = q.full("avg", "close", 5), q.full("avg", "close", 20)
_DAILY += [
    f"close / ({_FIVE}) - 1 AS price_vs_sma5",
    f"close / ({_TWENTY}) - 1 AS price_vs_sma20",
    f"({_FIVE}) / ({_TWENTY}) - 1 AS sma5_vs_sma20",
    f"{q.full('stddev_samp', 'r', 10)} AS volatility_10d",
    f"volume::DOUBLE / nullif(lag(volume::DOUBLE, 5) OVER ({q.S}), 0) - 1 AS volume_change_5d",
]
DAILY_COLUMNS = [*(f"return_{n}d" for n in indicators.RETURN_LAGS), "price_vs_sma5", "price_vs_sma20", "sma5_vs_sma20", "rsi_14", "volatility_10d", "volume_change_5d"]
DAILY_CTES = (
    q.BARS, q.RETURNS, q.RSI, f"daily1 AS (SELECT series_id, date, close, {', '.join(_DAILY)} FROM rets)",
    "daily AS (SELECT d.*, rsi AS rsi_14 FROM daily1 d JOIN rsi USING (series_id, date))",
)


@query(q.with_(*DAILY_CTES, select="SELECT series_id, date, " + ", ".join(f"{q.r6(c)} AS {c}" for c in DAILY_COLUMNS) + " FROM daily"))
def daily_features(spark, sf_dir):
    """Eleven daily features."""
    return _rounded(indicators.daily_features(panels.bars6(spark, sf_dir)), DAILY_COLUMNS)


@query(q.with_(q.BARS, select=f"SELECT series_id, date, CASE WHEN nx IS NOT NULL THEN (nx > close)::INT::DOUBLE END AS y FROM (SELECT *, lead(close) OVER ({q.S}) AS nx FROM bars)"))
def next_day_label(spark, sf_dir):
    """Direction of the next close."""
    return indicators.next_day_label(panels.bars6(spark, sf_dir))


@query(
    q.with_(
        q.PANEL,
        """days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM pbars),
        g AS (SELECT s.series_id, days.date, b.close FROM (SELECT DISTINCT series_id FROM pbars) s CROSS JOIN days LEFT JOIN pbars b ON b.series_id = s.series_id AND b.date = days.date
          WHERE isodow(days.date) < 6)""",
        select=f"SELECT series_id, date, last_value(close IGNORE NULLS) OVER ({q.S} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close, close IS NULL AS missing FROM g",
    )
)
def calendar_panel_ffill(spark, sf_dir):
    """The panel on business days, gaps carried forward up to five days."""
    return indicators.calendar_panel(panels.panel25(spark, sf_dir))


MONTH_ENDS = """
me AS (SELECT series_id, max(date) AS date FROM bars GROUP BY series_id, date_trunc('month', date)),
ends AS (SELECT series_id, date FROM (SELECT *, max(date) OVER (PARTITION BY series_id) AS final FROM me)
  WHERE date < final OR date >= last_day(date) - CAST(greatest(isodow(last_day(date)) - 5, 0) AS INTEGER))"""


@query(q.with_(q.BARS, MONTH_ENDS, select="SELECT series_id, date FROM ends"))
def month_end_dates(spark, sf_dir):
    """Decision dates: last dates of complete months."""
    return indicators.month_ends(panels.bars6(spark, sf_dir))


@query(
    q.with_(
        q.BARS,
        select="""SELECT series_id, count(*) AS n_bars, count(*) FILTER (close IS NULL OR close <= 0) AS bad_closes, count(*) - count(DISTINCT date) AS repeated_dates,
        count(*) >= 2 AND count(*) FILTER (close IS NULL OR close <= 0) = 0 AND count(*) = count(DISTINCT date) AS valid FROM bars GROUP BY series_id""",
    )
)
def price_quality(spark, sf_dir):
    """Contract checks of the bars."""
    return snapshots.price_quality(panels.bars6(spark, sf_dir))


def snapshot_table(spark, sf_dir) -> DataFrame:
    """Two sources of each series; the second one repeats the first one's content for half of them, one day later."""
    bars = panels.bars6(spark, sf_dir).withColumn("close", F.format_number("close", 6))
    own = snapshots.content_hash(bars).withColumnRenamed("series_id", "ticker")
    both = own.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    sha = F.when((F.col("k") == 1) & F.col("ticker").startswith("A"), F.sha2(F.concat("content_sha256", F.lit("x")), 256)).otherwise(F.col("content_sha256"))
    return both.select(
        F.concat_ws("-", "ticker", "source", "k").alias("snapshot_id"), "ticker", "source", F.date_sub("first_date", 1).alias("fetch_start"),
        F.date_add("last_date", F.col("k") + 1).alias("fetch_end"), "n_bars", sha.alias("content_sha256"), F.date_add("last_date", F.col("k")).alias("fetched_at"), "k",
    )


_SNAPS = """
h AS (SELECT series_id AS ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars,
  sha256(string_agg(strftime(date, '%Y-%m-%d') || ':' || format('{:,.6f}', close), '|' ORDER BY date)) AS s FROM bars GROUP BY 1),
snaps AS (SELECT ticker || '-' || source || '-' || k AS snapshot_id, ticker, source, first_date - 1 AS fetch_start, last_date + (k + 1)::INTEGER AS fetch_end, n_bars,
  CASE WHEN k = 1 AND ticker LIKE 'A%' THEN sha256(s || 'x') ELSE s END AS content_sha256, last_date + k::INTEGER AS fetched_at, k
  FROM h, (SELECT unnest(['a', 'b']) AS source), (SELECT unnest([0, 1]) AS k))"""


@query(
    q.with_(
        q.BARS,
        _SNAPS,
        select="SELECT ticker, source, n_bars, content_sha256 FROM snaps WHERE k = 1 AND (ticker, source, content_sha256) NOT IN (SELECT (ticker, source, content_sha256) FROM snaps WHERE k = 0)",
    )
)
def snapshot_dedupe(spark, sf_dir):
    """Later snapshots whose content isn't stored yet."""
    rows = snapshot_table(spark, sf_dir)
    fresh = snapshots.new_snapshots(rows.where("k = 0"), rows.where("k = 1"))
    return fresh.select("ticker", "source", "n_bars", "content_sha256")


def _requests(spark, sf_dir) -> DataFrame:
    bars = panels.bars6(spark, sf_dir).groupBy(F.col("series_id").alias("ticker")).agg(F.min("date").alias("start"), F.max("date").alias("last"))
    bars = bars.withColumn("extra", F.explode(F.array(F.lit(0), F.lit(2), F.lit(9))))
    return bars.select(F.concat_ws("/", "ticker", "extra").alias("request_id"), "ticker", "start", F.date_add("last", F.col("extra")).alias("end"))


@query(
    q.with_(
        q.BARS,
        _SNAPS,
        """req AS (SELECT ticker || '/' || e AS request_id, ticker, first_date AS start, last_date + e::INTEGER AS "end" FROM h, (SELECT unnest([0, 2, 9]) AS e))""",
        select="""SELECT request_id, snapshot_id FROM req JOIN snaps USING (ticker) WHERE fetch_start <= start AND fetch_end >= "end"
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY fetched_at DESC, snapshot_id DESC) = 1""",
    )
)
def newest_covering_snapshot(spark, sf_dir):
    """The newest snapshot that covers each request."""
    found = snapshots.newest_covering(_requests(spark, sf_dir), snapshot_table(spark, sf_dir))
    return found.select("request_id", "snapshot_id")


@query(
    """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'momentum' ELSE 'sma_crossover' END AS strategy,
  CASE WHEN o_orderkey % 7 = 0 THEN 'bad ticker' ELSE 't' || o_custkey END AS ticker, CAST(o_orderdate AS DATE) AS d, (o_orderkey % 11 * 100)::DOUBLE AS cost_bps,
  (o_orderkey % 13)::DOUBLE * 30 AS a, (o_orderkey % 17)::DOUBLE * 30 AS b, o_orderkey % 3 AS m FROM orders)
SELECT o_orderkey AS request_id, count(*) AS copies, CASE WHEN strategy = 'unknown' THEN 'strategy' WHEN ticker = 'bad ticker' THEN 'ticker' WHEN m = 0 THEN 'end'
  WHEN strategy = 'momentum' THEN CASE WHEN a NOT BETWEEN 1 AND 500 THEN 'lookback' END
  WHEN a NOT BETWEEN 2 AND 250 THEN 'short_window' WHEN b NOT BETWEEN 3 AND 500 THEN 'long_window' WHEN a >= b THEN 'short_window' END AS reason
FROM o GROUP BY ALL"""
)
def request_validation(spark, sf_dir):
    """Requests made of orders, each with the first field at fault; equal requests are counted."""
    o = panels.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    a, b = (key % 13).cast("double") * 30, (key % 17).cast("double") * 30
    strategy = F.when(key % 5 == 0, "unknown").when(key % 5 == 1, "momentum").otherwise("sma_crossover")
    date = F.to_date("o_orderdate")
    requests = o.select(
        key.alias("request_id"),
        strategy.alias("strategy"),
        F.when(strategy == "momentum", F.create_map(F.lit("lookback"), a)).otherwise(F.create_map(F.lit("short_window"), a, F.lit("long_window"), b)).alias("params"),
        F.when(key % 7 == 0, "bad ticker").otherwise(F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).alias("ticker"),
        date.alias("start"),
        F.when(key % 3 == 0, date).otherwise(F.date_add(date, 365)).alias("end"),
        (key % 11 * 100).cast("double").alias("cost_bps"),
        F.lit(0).alias("n_boot"),
    )
    bounds = {name: spec.bounds for name, spec in signals.CATALOG.items()}
    checked = snapshots.validated_requests(requests, bounds)
    columns = ["strategy", "ticker", "start", "end", "cost_bps", "n_boot"]
    checked = checked.withColumn("hash", snapshots.request_hash([*columns, "params"]))
    return checked.groupBy("request_id", "hash", "reason").agg(F.count("*").alias("copies")).select("request_id", "copies", "reason")


@query(
    q.with_(
        *STACKED_CTES,
        select="""SELECT run_id, series_id, sha256(string_agg(format('{:,.10f}', signal), ',' ORDER BY date)) AS fingerprint, count(*) AS rows FROM runs GROUP BY run_id, series_id""",
    )
)
def signal_fingerprints(spark, sf_dir):
    """A hash of each run's positions."""
    return signals.fingerprint(stacked_runs(spark, sf_dir)[1])


@query(
    q.with_(
        *STACKED_CTES,
        select="""SELECT run_id, series_id, date, round(eq, 6) + 0.0::DOUBLE AS equity_curve, round(eq / max(eq) OVER (PARTITION BY run_id, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0::DOUBLE AS drawdown
        FROM (SELECT *, product(1 + strategy_return) OVER (PARTITION BY run_id, series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM bt)""",
    )
)
def stored_run_series(spark, sf_dir):
    """Runs packed into arrays and read back, with their drawdown."""
    rows = snapshots.series_source(snapshots.series_sink(stacked_runs(spark, sf_dir)[2]))
    w = ordered(["run_id", "series_id"])
    return rows.select("run_id", "series_id", "date", r6("equity_curve").alias("equity_curve"), r6(reports.drawdown(F.col("equity_curve"), w)).alias("drawdown"))


@query(
    """
WITH e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS date, round(avg(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT series_id, date, round(sum(v) OVER w, 4) + 0.0::DOUBLE AS day_sum, round(max(v) OVER w, 4) + 0.0::DOUBLE AS day_top, n FROM e
WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""
)
def hourly_event_bars(spark, sf_dir):
    """Hourly bars of events with the sum and maximum of the last 24."""
    w = ordered().rowsBetween(-23, Window.currentRow)
    rows = panels.bars_events(spark, sf_dir)
    total, top = F.sum("close").over(w), F.max("close").over(w)
    return rows.select("series_id", "date", F.round(total, 4).alias("day_sum"), F.round(top, 4).alias("day_top"), F.col("volume").alias("n"))

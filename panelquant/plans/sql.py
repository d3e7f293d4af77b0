"""Shared pieces of the queries' DuckDB SQL."""

from __future__ import annotations

S = "PARTITION BY series_id ORDER BY date"


def rows(n: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {rows(n)} >= {least or n} THEN {agg}({x}) {rows(n)} END"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


_FLOW = """
{p}d AS (
  SELECT {series} AS series_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_discount), 6) - 0.05 AS x,
         avg(l_tax) AS t, sum(l_quantity) AS q
  FROM {source} GROUP BY 1, 2
), {p}c AS (
  SELECT *, round(100 * product(1 + x) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS close FROM {p}d
), {p}bars AS (
  SELECT series_id, date, close, round(close * (1 + t / 4), 6) AS high, round(close * (1 - t / 4), 6) AS low,
         CAST(q AS BIGINT) AS volume FROM {p}c
)"""
BARS = _FLOW.format(p="", series="l_returnflag || l_linestatus", source="lineitem")
PANEL = _FLOW.format(p="p", series="p_brand", source="lineitem JOIN part ON l_partkey = p_partkey")

RETURNS = f"""
rets AS (
  SELECT *, close - lag(close) OVER ({S}) AS delta, close / lag(close) OVER ({S}) - 1 AS r FROM bars
)"""

SMA = f"""
sma AS (
  SELECT series_id, date, close,
         CASE WHEN count(close) {rows(200)} = 200 AND avg(close) {rows(50)} > avg(close) {rows(200)} THEN 1.0 ELSE 0.0 END::DOUBLE AS signal
  FROM bars
)"""
MOMENTUM = f"""
mom AS (SELECT series_id, date, close, CASE WHEN close / lag(close, 20) OVER ({S}) - 1 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM bars)"""
RSI = f"""
gains AS (SELECT *, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss FROM (SELECT * FROM rets) WHERE delta IS NOT NULL
  UNION ALL SELECT *, NULL, NULL FROM rets WHERE delta IS NULL),
rsis AS (
  SELECT series_id, date, close, {full("avg", "gain", 14)} AS up, {full("avg", "loss", 14)} AS down FROM gains
), rsi AS (
  SELECT series_id, date, close, CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END::DOUBLE AS rsi FROM rsis
), revert AS (
  SELECT series_id, date, close, coalesce(last_value(s IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS signal
  FROM (SELECT *, CASE WHEN rsi > 70 THEN 0.0 WHEN rsi < 30 THEN 1.0 END AS s FROM rsi)
)"""


def backtest(signals: str, out: str = "bt", keys: str = "series_id", cost: float = 5.0) -> str:
    """CTEs from (keys, date, close, signal) to a backtest ``out``."""
    w = f"PARTITION BY {keys} ORDER BY date"
    return f"""
{out}1 AS (
  SELECT *, close / lag(close) OVER ({w}) - 1 AS daily_return, coalesce(lag(signal) OVER ({w}), 0.0) AS position FROM {signals}
), {out}2 AS (
  SELECT *, position * daily_return AS gross_return,
         coalesce(abs(position - lag(position) OVER ({w})), abs(position)) * {cost} / 10000.0 AS cost FROM {out}1
), {out} AS (SELECT *, gross_return - cost AS strategy_return FROM {out}2)"""


def report(source: str, keys: str, out: str = "rep") -> str:
    """CTEs from backtest rows to the full report of each key."""
    w = f"PARTITION BY {keys} ORDER BY date"
    dev = "stddev_samp(ret)"
    down = "stddev_samp(CASE WHEN ret < 0 THEN ret END)"
    return f"""
{out}1 AS (
  SELECT *, coalesce(strategy_return, 0.0) AS ret,
         product(1 + coalesce(strategy_return, 0.0)) OVER ({w} ROWS UNBOUNDED PRECEDING) AS equity,
         abs(position - lag(position) OVER ({w})) AS moved FROM {source}
), {out}2 AS (
  SELECT *, equity / max(equity) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM {out}1
), {out} AS (
  SELECT {keys}, count(*) AS n, max_by(equity, date) - 1 AS total_return, count(*) FILTER (moved > 0) AS num_trades,
         CASE WHEN count(*) FILTER (ret <> 0) > 0 THEN count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0) ELSE 0.0 END AS win_rate,
         avg(abs(position)) AS exposure,
         CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(sum(moved), 0) / (count(*) / 252) END AS turnover,
         CASE WHEN count(*) < 2 THEN 0.0 ELSE exp((ln(max_by(equity, date)) - ln(min_by(equity, date))) * 252 / count(*)) - 1 END AS cagr,
         {dev} * sqrt(252) AS annualized_volatility,
         CASE WHEN {dev} > 1e-12 THEN avg(ret) / {dev} * sqrt(252) ELSE 0.0 END AS sharpe_ratio,
         CASE WHEN {down} > 1e-12 THEN avg(ret) / {down} * sqrt(252) ELSE 0.0 END AS sortino_ratio,
         min(drawdown) AS max_drawdown
  FROM {out}2 GROUP BY {keys}
)"""


REPORT_COLUMNS = (
    "total_return", "win_rate", "exposure", "turnover", "cagr", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
)
REPORT_SELECT = "n, num_trades, " + ", ".join(f"{r6(c)} AS {c}" for c in REPORT_COLUMNS)

_VOL = f"round({full('stddev_samp', 'r', 20)} * sqrt(252), 12)"
REGIME_FEATURES = f"""
f1 AS (
  SELECT *, {_VOL} AS vol_20d, {full("stddev_samp", "r", 100)} * sqrt(252) AS vol_slow, {full("avg", "close", 50)} AS sma_mid,
         lag(r) OVER ({S}) AS lagged_r, volume::DOUBLE AS v, ln(high / low) ** 2 AS lr2, (high - low) / close AS rp,
         abs(delta) AS ad, r * r AS rr, least(r, 0) * least(r, 0) AS dd,
         ln(1 + abs(r) / nullif(volume::DOUBLE * close, 0) * 1e9) AS ill
  FROM (SELECT * FROM rets)
), f2 AS (
  SELECT series_id, date, close, r, vol_20d, vol_20d / nullif(vol_slow, 0) AS vol_ratio, close / lag(close, 60) OVER ({S}) - 1 AS trend_60d,
         close / ({full("avg", "close", 252)}) - 1 AS price_vs_sma200,
         (sma_mid - lag(sma_mid, 20) OVER ({S})) / close AS sma_slope,
         abs(close - lag(close, 60) OVER ({S})) / nullif({full("sum", "ad", 60)}, 0) AS efficiency_ratio,
         CASE WHEN count(lagged_r) {rows(60)} = 60 AND stddev_pop(r) {rows(60)} * stddev_pop(lagged_r) {rows(60)} > 1e-14
           THEN covar_pop(r, lagged_r) {rows(60)} / (stddev_pop(r) {rows(60)} * stddev_pop(lagged_r) {rows(60)}) END AS autocorr_60,
         close / ({full("max", "close", 252, 20)}) - 1 AS drawdown_252d,
         sqrt({full("avg", "dd", 20)}) / nullif(sqrt({full("avg", "rr", 20)}), 0) AS downside_share,
         sqrt(({full("avg", "lr2", 20)}) / (4 * ln(2)) * 252) AS parkinson_vol, {full("avg", "rp", 20)} AS range_pct,
         (v - ({full("avg", "v", 126, 20)})) / nullif({full("stddev_samp", "v", 126, 20)}, 0) AS volume_z,
         ({full("avg", "v", 20)}) / nullif({full("avg", "v", 126, 20)}, 0) AS volume_trend,
         {full("avg", "ill", 20)} AS illiquidity
  FROM (SELECT * REPLACE (CASE WHEN r IS NULL THEN NULL ELSE dd END AS dd) FROM f1)
), ranks AS (
  SELECT a.series_id, a.date, (count(*) FILTER (b.vol_20d < a.vol_20d) + (count(*) FILTER (b.vol_20d = a.vol_20d) + 1) / 2) / count(*) AS rk, count(*) AS k
  FROM f2 a JOIN f2 b ON a.series_id = b.series_id AND b.date <= a.date AND b.vol_20d IS NOT NULL WHERE a.vol_20d IS NOT NULL GROUP BY ALL
), feats AS (
  SELECT f2.*, CASE WHEN k >= 20 THEN rk END AS vol_percentile FROM f2 LEFT JOIN ranks USING (series_id, date)
)"""
FEATURES = (
    "vol_20d", "vol_ratio", "trend_60d", "price_vs_sma200", "sma_slope", "efficiency_ratio", "autocorr_60", "drawdown_252d", "downside_share",
    "parkinson_vol", "range_pct", "volume_z", "volume_trend", "illiquidity", "vol_percentile",
)


def zscore(x: str) -> str:
    w = f"OVER ({S} ROWS UNBOUNDED PRECEDING)"
    return (
        f"CASE WHEN count({x}) {w} >= 60 THEN CASE WHEN {x} IS NOT NULL AND stddev_samp({x}) {w} <> 0 "
        f"THEN greatest(-5.0, least(5.0, ({x} - avg({x}) {w}) / stddev_samp({x}) {w})) END END"
    )


RULES = f"""
scaled AS (SELECT series_id, date, {", ".join(f"{zscore(c)} AS {c}" for c in FEATURES)} FROM feats),
rules AS (
  SELECT series_id, date, CASE WHEN {" OR ".join(f"s.{c} IS NULL" for c in FEATURES)} THEN -1
    ELSE CASE WHEN f.vol_percentile >= 0.70 THEN 2 ELSE 0 END + CASE WHEN f.trend_60d > 0 THEN 0 ELSE 1 END END AS label
  FROM feats f JOIN scaled s USING (series_id, date)
)"""
CONFIRMED = f"""
lab AS (SELECT * FROM rules WHERE label <> -1),
lab2 AS (SELECT *, count(*) FILTER (new) OVER ({S} ROWS UNBOUNDED PRECEDING) AS block
  FROM (SELECT *, coalesce(lag(label) OVER ({S}) <> label, true) AS new FROM lab)),
lab3 AS (SELECT *, row_number() OVER (PARTITION BY series_id, block ORDER BY date) AS streak FROM lab2),
smooth AS (SELECT series_id, date, coalesce(last_value(CASE WHEN streak >= 5 THEN label END IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING),
  first_value(label) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS label FROM lab3),
labels5 AS (SELECT series_id, date, coalesce(s.label, -1) AS label FROM rules LEFT JOIN smooth s USING (series_id, date))"""
LABELS = ",".join([BARS, RETURNS, REGIME_FEATURES, RULES, CONFIRMED])
EPISODES = f"""
ep1 AS (SELECT *, coalesce(lag(label) OVER ({S}) <> label, true) AS new FROM labels5 WHERE label <> -1),
ep2 AS (SELECT *, count(*) FILTER (new) OVER ({S} ROWS UNBOUNDED PRECEDING) AS block FROM ep1),
episodes AS (SELECT series_id, block, label, min(date) AS "start", max(date) AS "end", count(*) AS days FROM ep2 GROUP BY series_id, block, label)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select

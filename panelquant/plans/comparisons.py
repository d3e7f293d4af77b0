"""Strategies compared, folds stitched, legs of a portfolio, and how much of a label is known before it."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelquant.functions.columns import r6
from panelquant.operators import adaptive, backtest, comparison, learning, portfolio, regimes, resampling
from panelquant.sources import panels

from . import sql as q
from .labels import features
from .registry import query
from .runs import _XS, MONTH_ENDS, RUNS, STACKED_CTES, _weights
from .serving import _REGIME_MONTHLY
from .studies import _ADAPT, _FOLDS, _SPLIT, _SWITCH, MONTHLY, _learned

_P = "PARTITION BY series_id ORDER BY date"
_LEGS = """
{out}a AS (SELECT series_id, date, coalesce(lag(weight) OVER (PARTITION BY series_id ORDER BY date), 0.0) AS position,
  coalesce(close / nullif(lag(close) OVER (PARTITION BY series_id ORDER BY date), 0) - 1, 0.0) AS r FROM {source}),
{out}b AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY date), 0.0) AS was FROM {out}a),
{out}c AS (SELECT date, sum(greatest(position, 0) * r) AS long_gross, sum(abs(greatest(position, 0) - greatest(was, 0))) * 5.0 / 10000 AS long_cost,
  sum(least(position, 0) * r) AS short_gross, sum(abs(least(position, 0) - least(was, 0))) * 5.0 / 10000 AS short_cost FROM {out}b GROUP BY date),
{out} AS (SELECT *, long_gross - long_cost AS long_return, short_gross - short_cost AS short_return, long_gross - long_cost + short_gross - short_cost AS strategy_return FROM {out}c)"""
_NEUTRAL = f"""
be1 AS (SELECT *, close / nullif(lag(close) OVER ({_P}), 0) - 1 AS r FROM xs),
be2 AS (SELECT be1.*, market FROM be1 JOIN (SELECT date, avg(r) AS market FROM be1 GROUP BY date) USING (date)),
be AS (SELECT series_id, date, weight, date = max(date) OVER (PARTITION BY date_trunc('month', date)) AS is_end,
  CASE WHEN count(r) {q.rows(252)} >= 126 THEN regr_slope(r, market) {q.rows(252)} END AS beta FROM be2),
sc1 AS (SELECT date, sum(greatest(weight, 0) * beta) AS l, sum(least(weight, 0) * beta) AS s, count(*) FILTER (beta IS NULL) AS unknown FROM be WHERE is_end AND weight <> 0 GROUP BY date),
sc AS (SELECT date, CASE WHEN unknown = 0 AND l > 0 AND s < 0 THEN -l / s ELSE 1.0 END::DOUBLE AS own FROM sc1),
bn1 AS (SELECT xs.*, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY xs.series_id ORDER BY xs.date ROWS UNBOUNDED PRECEDING), 1.0) AS scale FROM xs LEFT JOIN sc ON sc.date = xs.date),
bn AS (SELECT series_id, date, close, CASE WHEN weight < 0 THEN weight * scale ELSE weight END AS weight, scale FROM bn1)"""
_SUMS = ("long_return", "short_return", "strategy_return", "long_cost", "short_cost", "total_return")


def _neutral(spark, sf_dir):
    return portfolio.beta_neutral(_weights(spark, sf_dir))


@query(q.with_(q.PANEL, _XS, _NEUTRAL, select=f"SELECT series_id, date, {q.r6('weight')} AS weight, {q.r6('scale')} AS scale FROM bn WHERE weight <> 0"))
def beta_neutral_weights(spark, sf_dir):
    """Momentum weights whose short leg is scaled to the long leg's beta, the days held."""
    return _neutral(spark, sf_dir).where("weight <> 0").select("series_id", "date", r6("weight").alias("weight"), r6("scale").alias("scale"))


@query(
    q.with_(
        q.PANEL, _XS, _NEUTRAL, _LEGS.format(out="lp", source="xs"), _LEGS.format(out="ln", source="bn"),
        "la AS (SELECT 'plain' AS variant, * FROM lp UNION ALL SELECT 'beta_neutral', * FROM ln)",
        select="SELECT variant, year(date)::INT AS year, count(*) AS days, " + ", ".join(f"{q.r6(f'sum({c})')} AS {c}" for c in _SUMS[:-1])
        + f", {q.r6('product(1 + strategy_return) - 1')} AS total_return FROM la GROUP BY ALL",
    )
)
def leg_attribution(spark, sf_dir):
    """What each leg earned and cost by year, with plain and with beta-neutral weights."""
    plain, neutral = _weights(spark, sf_dir), _neutral(spark, sf_dir)
    columns = ["variant", "series_id", "date", "close", "weight"]
    both = plain.withColumn("variant", F.lit("plain")).select(*columns).unionByName(neutral.withColumn("variant", F.lit("beta_neutral")).select(*columns))
    days = portfolio.leg_returns(both, keys=["variant"]).withColumn("year", F.year("date"))
    return portfolio.leg_attribution(days, ["variant", "year"]).withColumns({c: r6(c) for c in _SUMS})


#: The runs compared, two of which have no plan.
_TRIED = [*RUNS[:3], ("typo", "momentum", {"lookbak": 20}), ("absent", "no_such_strategy", {})]
_Z = f"""
bh AS (SELECT series_id, sr AS held FROM sk WHERE run_id = 'hold'),
zs AS (SELECT run_id, series_id, (sr - held - {resampling.expected_best(len(_TRIED))!r}::DOUBLE / sqrt(n - 1)) / sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS z
  FROM sk JOIN bh USING (series_id) WHERE run_id <> 'hold')"""


@query(
    q.with_(
        *STACKED_CTES, _SPLIT, q.report("hv", "run_id, series_id, half"),
        """mo AS (SELECT run_id, series_id, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS s, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4
          FROM (SELECT run_id, series_id, coalesce(strategy_return, 0.0) AS ret FROM hv WHERE half = 'out_of_sample') GROUP BY ALL),
        sk AS (SELECT *, CASE WHEN s > 1e-12 THEN m / s ELSE 0.0 END AS sr, (m3 - 3 * m * m2 + 2 * m ** 3) / sp ** 3 AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / sp ** 4 AS kurt FROM mo)""",
        _Z,
        """wd AS (SELECT run_id, series_id, max(sharpe_ratio) FILTER (half = 'in_sample') AS is_sharpe, max(sharpe_ratio) FILTER (half = 'out_of_sample') AS oos_sharpe,
          max(total_return) FILTER (half = 'out_of_sample') AS oos_return, max(max_drawdown) FILTER (half = 'out_of_sample') AS oos_max_dd,
          max(exposure) FILTER (half = 'out_of_sample') AS oos_exposure, max(turnover) FILTER (half = 'out_of_sample') AS turnover FROM rep GROUP BY ALL)""",
        select="SELECT CASE WHEN run_id = 'hold' THEN 'buy_and_hold' ELSE run_id END AS run_id, series_id, "
        + ", ".join(f"{q.r6(c)} AS {c}" for c in ("is_sharpe", "oos_sharpe", "is_sharpe - oos_sharpe")).replace("AS is_sharpe - oos_sharpe", "AS sharpe_decay")
        + ", " + ", ".join(f"{q.r6(c)} AS {c}" for c in ("oos_return", "oos_max_dd", "oos_exposure", "turnover"))
        + f""", round(z, 5) + 0.0::DOUBLE AS z, {len(_TRIED)}::INT AS n_trials, false AS failed FROM wd LEFT JOIN zs USING (run_id, series_id)
        UNION ALL SELECT f, series_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {len(_TRIED)}::INT, true FROM (SELECT DISTINCT series_id FROM bars), (SELECT unnest(['typo', 'absent']) AS f)""",
    )
)
def strategy_comparison(spark, sf_dir):
    """Candidates against buying and holding, in and out of sample; two candidates without a plan become error rows."""
    rows = comparison.comparison(panels.bars6(spark, sf_dir).select("series_id", "date", "close"), _TRIED)
    rows = rows.withColumns({c: r6(c) for c in comparison.MEASURES if c != "z"}).withColumn("z", F.round("z", 5) + F.lit(0.0))
    return rows.withColumn("failed", F.col("error").isNotNull()).drop("error", "deflated_sharpe")


_STITCHED = ("mean_sharpe", "worst_sharpe", "share_positive")


def _stitched_sql(keys: str) -> tuple[str, ...]:
    """CTEs from ``folds`` with a column ``able`` to the stitched report ``st``."""
    return (
        q.report("(SELECT * FROM folds2 WHERE able)", keys, "rs"),
        q.report("(SELECT * FROM folds2 WHERE able)", f"{keys}, fold", "rf"),
        f"fc AS (SELECT {keys}, count(DISTINCT fold) AS folds, count(DISTINCT fold) FILTER (able) AS scored FROM folds2 GROUP BY ALL)",
        f"fe AS (SELECT {keys}, avg(sharpe_ratio) AS mean_sharpe, min(sharpe_ratio) AS worst_sharpe, avg((sharpe_ratio > 0)::INT) AS share_positive FROM rf GROUP BY ALL)",
    )


_STITCHED_SELECT = f"folds, scored, {q.REPORT_SELECT}, " + ", ".join(f"{q.r6(c)} AS {c}" for c in _STITCHED)


@query(
    q.with_(
        *_ADAPT, _SWITCH, "sr AS (SELECT 'switch' AS run_id, * FROM sw UNION ALL SELECT 'momentum', * FROM mom)", q.backtest("sr", "st", "run_id, series_id"),
        _FOLDS.replace("FROM bt)", "FROM st)"),
        """folds2 AS (SELECT folds.*, run_id = 'momentum' OR min(date) OVER (PARTITION BY run_id, series_id, fold) >= oos_from AS able FROM folds JOIN le USING (series_id))""",
        *_stitched_sql("run_id, series_id"),
        select=f"SELECT run_id, series_id, {_STITCHED_SELECT} FROM rs JOIN fc USING (run_id, series_id) JOIN fe USING (run_id, series_id)",
    )
)
def stitched_folds(spark, sf_dir):
    """The regime switch on the folds after its learning cutoff, and momentum on all, each as one stitched curve."""
    bars, labels, runs, ends, table = _learned(spark, sf_dir)
    switched = adaptive.regime_switch(runs, labels, adaptive.best_per_regime(table), ends).withColumn("run_id", F.lit("switch"))
    columns = ["run_id", "series_id", "date", "signal"]
    both = switched.select(*columns).unionByName(runs.where("run_id = 'momentum'").select(*columns))
    rows = backtest.run_backtest(bars, both).join(ends.select("series_id", "oos_from"), "series_id")
    out = comparison.stitched_report(rows, oos_from=F.when(F.col("run_id") == "switch", F.col("oos_from")))
    return out.withColumns({c: r6(c) for c in (*q.REPORT_COLUMNS, *_STITCHED)})


#: Look-backs of the rules' trend and volatility. Fixed values.
_LOOKBACKS = {"trend": 60, "vol": 20}


def _known(w: int) -> str:
    n = f"least(m, {w})"
    return f"round(avg(({w} * {n} - {n} * ({n} + 1) / 2) / ({w} * m)), 6)"


@query(
    q.with_(
        q.LABELS, MONTH_ENDS, MONTHLY, _REGIME_MONTHLY,
        "dd AS (SELECT rm.*, (SELECT count(*) FROM bars b WHERE b.series_id = rm.series_id AND b.date > rm.t0 AND b.date <= rm.t1) AS m FROM rm)",
        select=f"""SELECT series_id, count(*) AS samples, round(avg((y = regime_rules)::INT), 6) AS decision_agrees, round(avg((y = previous)::INT), 6) AS previous_agrees,
        {", ".join(f"{_known(w)} AS known_{name}" for name, w in _LOOKBACKS.items())} FROM dd GROUP BY series_id""",
    )
)
def label_determinacy(spark, sf_dir):
    """How much of the next month's regime label is known at its decision date."""
    bars = panels.bars6(spark, sf_dir)
    samples = learning.regime_dataset(bars, regimes.rules_labels(features(spark, sf_dir)))
    out = learning.label_determinacy(bars, samples, _LOOKBACKS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("series_id", "samples")})

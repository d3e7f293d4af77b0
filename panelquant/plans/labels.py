"""Regime features, labels and what happened under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.functions.columns import r6
from panelquant.operators import backtest, indicators, learning, regimes, reports, signals, validation
from panelquant.sources import panels

from . import sql as q
from .registry import query
from .runs import MONTH_ENDS

_HEAD = (q.BARS, q.RETURNS, q.REGIME_FEATURES)
STATES = (0, 1, 2, 3)


def features(spark, sf_dir) -> DataFrame:
    return indicators.regime_features(panels.bars6(spark, sf_dir))


def labels5(spark, sf_dir) -> DataFrame:
    """Rules labels, confirmed over five days."""
    return regimes.confirmed(regimes.rules_labels(features(spark, sf_dir)), 5)


#: Ratios of small counts would meet ties at six decimals.
_DIGITS = {"volume_trend": 9, "vol_percentile": 9}


@query(
    q.with_(
        *_HEAD,
        select="SELECT series_id, date, " + ", ".join(f"round({c}, {_DIGITS.get(c, 6)}) + 0.0::DOUBLE AS {c}" for c in q.FEATURES) + " FROM feats",
    )
)
def regime_features(spark, sf_dir):
    """Fifteen regime features."""
    rows = features(spark, sf_dir)
    return rows.select("series_id", "date", *[(F.round(c, _DIGITS.get(c, 6)) + F.lit(0.0)).alias(c) for c in q.FEATURES])


_Z = ("vol_20d", "trend_60d", "volume_z")


@query(q.with_(*_HEAD, select="SELECT series_id, date, " + ", ".join(f"round({q.zscore(c)}, 6) + 0.0::DOUBLE AS {c}" for c in _Z) + " FROM feats"))
def expanding_zscore(spark, sf_dir):
    """z-scores of features against their own past."""
    rows = indicators.standardized(features(spark, sf_dir), _Z)
    return rows.select("series_id", "date", *[r6(c).alias(c) for c in _Z])


@query(
    q.with_(
        q.PANEL,
        """r AS (SELECT a.series_id, a.date, (count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2) / count(*) AS rk
        FROM pbars a JOIN pbars b ON a.series_id = b.series_id AND b.date <= a.date GROUP BY ALL)""",
        select="SELECT series_id, date, round(rk, 6) + 0.0::DOUBLE AS rk FROM r",
    )
)
def expanding_rank(spark, sf_dir):
    """Rank of each close among the closes so far."""
    rows = indicators.expanding_rank(panels.panel25(spark, sf_dir).select("series_id", "date", "close"), "close", "rk", 1)
    return rows.select("series_id", "date", r6("rk").alias("rk"))


@query(q.with_(*_HEAD, q.RULES, select="SELECT series_id, date, label FROM rules"))
def rules_regimes(spark, sf_dir):
    """Labels by two thresholds."""
    return regimes.rules_labels(features(spark, sf_dir))


@query(q.with_(q.LABELS, select="SELECT series_id, date, label FROM labels5"))
def min_duration_labels(spark, sf_dir):
    """Labels confirmed over five days."""
    return labels5(spark, sf_dir)


@query(
    q.with_(
        *_HEAD,
        q.RULES,
        """lab AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM rules WHERE label <> -1),
        votes AS (SELECT a.series_id, a.date, b.label, count(*) AS n FROM lab a JOIN lab b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 4 AND a.i GROUP BY ALL),
        mode AS (SELECT series_id, date, label FROM votes QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY n DESC, label) = 1)""",
        select="SELECT r.series_id, r.date, coalesce(m.label, -1) AS label FROM rules r LEFT JOIN mode m USING (series_id, date)",
    )
)
def median_labels(spark, sf_dir):
    """The most frequent of the last five labels."""
    return regimes.rolling_mode(regimes.rules_labels(features(spark, sf_dir)), 5)


@query(q.with_(q.LABELS, q.EPISODES, select='SELECT series_id, label, "start", "end", days FROM episodes'))
def regime_episodes(spark, sf_dir):
    """Runs of one label."""
    return reports.episodes(labels5(spark, sf_dir)).drop("block")


@query(
    q.with_(
        q.LABELS,
        q.EPISODES,
        select="""SELECT series_id, count(*) AS episodes, median(days)::DOUBLE AS median_days, round(avg(days), 6) AS mean_days, min(days) AS shortest_days,
        round((count(*) - 1) / (sum(days) / 252), 6) AS switches_per_year FROM episodes GROUP BY series_id""",
    )
)
def regime_stability(spark, sf_dir):
    """How long episodes last."""
    rows = reports.stability(labels5(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_days", "switches_per_year")})


@query(
    q.with_(
        q.LABELS,
        q.EPISODES,
        select="SELECT label, least(days // 20, 10)::BIGINT AS bucket, count(*) AS episodes FROM episodes GROUP BY ALL",
    )
)
def episode_histogram(spark, sf_dir):
    """Episode lengths in steps of twenty days."""
    rows = reports.episodes(labels5(spark, sf_dir))
    return rows.groupBy("label", F.least(F.floor(F.col("days") / 20), F.lit(10)).alias("bucket")).agg(F.count("*").alias("episodes"))


@query(
    q.with_(
        q.LABELS,
        f"""mv AS (SELECT *, lead(label) OVER ({q.S}) AS nx FROM labels5 WHERE label <> -1),
        cnt AS (SELECT series_id, label AS f, nx AS t, count(*) AS n FROM mv WHERE nx IS NOT NULL GROUP BY ALL),
        grid AS (SELECT s.series_id, a.f, b.t FROM (SELECT DISTINCT series_id FROM labels5) s, (SELECT unnest([0, 1, 2, 3]) AS f) a, (SELECT unnest([0, 1, 2, 3]) AS t) b),
        mat AS (SELECT g.*, coalesce(n, 0) AS moves FROM grid g LEFT JOIN cnt USING (series_id, f, t))""",
        select="""SELECT series_id, f AS "from", t AS "to", moves, round(coalesce(moves / nullif(sum(moves) OVER (PARTITION BY series_id, f), 0), 0), 6) + 0.0::DOUBLE AS share FROM mat""",
    )
)
def transition_matrix(spark, sf_dir):
    """Moves between labels, counts and shares."""
    rows = reports.transition_matrix(labels5(spark, sf_dir), STATES)
    return rows.withColumn("share", r6("share"))


def _by_regime(position: str, ret: str) -> str:
    w = "PARTITION BY series_id, label ORDER BY date ROWS UNBOUNDED PRECEDING"
    return f"""
g1 AS (SELECT b.*, l.label, coalesce({ret}, 0.0) AS ret, {position} AS pos FROM bt b JOIN labels5 l USING (series_id, date) WHERE l.label <> -1),
g2 AS (SELECT *, product(1 + ret) OVER ({w}) AS eq FROM g1), g3 AS (SELECT *, eq / max(eq) OVER ({w}) - 1 AS dd FROM g2)
SELECT series_id, label AS regime, count(*) AS days, round(max_by(eq, date) - 1, 6) + 0.0::DOUBLE AS total_return,
  round(exp(ln(1 + avg(ret)) * 252) - 1, 6) + 0.0::DOUBLE AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) + 0.0::DOUBLE AS annualized_volatility,
  round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS sharpe_ratio,
  round(CASE WHEN stddev_samp(CASE WHEN ret < 0 THEN ret END) > 1e-12 THEN avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS sortino_ratio,
  round(min(dd), 6) + 0.0::DOUBLE AS max_drawdown,
  round(CASE WHEN count(*) FILTER (ret <> 0) > 0 THEN count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0) ELSE 0 END, 6) + 0.0::DOUBLE AS win_rate,
  round(avg(abs(pos)), 6) + 0.0::DOUBLE AS exposure FROM g3 GROUP BY series_id, label"""


_REGIME_COLUMNS = ("total_return", "ann_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "exposure")


def _sma(spark, sf_dir) -> DataFrame:
    bars = panels.bars6(spark, sf_dir)
    return backtest.run_backtest(bars, signals.sma_crossover(bars))


@query("WITH " + ",".join([q.LABELS, q.SMA, q.backtest("sma")]) + "," + _by_regime("position", "strategy_return"))
def performance_by_regime(spark, sf_dir):
    """The SMA crossover's metrics inside each regime."""
    rows = reports.performance_by_regime(_sma(spark, sf_dir), labels5(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in _REGIME_COLUMNS})


@query("WITH " + ",".join([q.LABELS, q.SMA, q.backtest("sma")]) + "," + _by_regime("1.0", "daily_return"))
def benchmark_by_regime(spark, sf_dir):
    """The same for holding the asset."""
    rows = reports.benchmark_by_regime(_sma(spark, sf_dir), labels5(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in _REGIME_COLUMNS})


@query(
    q.with_(
        q.LABELS,
        q.EPISODES,
        """rs AS (SELECT r.series_id, l.label, count(*) AS days, avg(r) AS m, stddev_samp(r) AS s, min(r) AS worst FROM rets r JOIN labels5 l USING (series_id, date) WHERE l.label <> -1 GROUP BY ALL),
        es AS (SELECT series_id, label, count(*) AS episodes, avg(days) AS mean_days FROM episodes GROUP BY ALL)""",
        select="""SELECT series_id, label, days, round(exp(ln(1 + m) * 252) - 1, 6) + 0.0::DOUBLE AS ann_return, round(s * sqrt(252), 6) + 0.0::DOUBLE AS ann_volatility,
        round(CASE WHEN s > 1e-12 THEN m / s * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS sharpe_ratio, round(worst, 6) + 0.0::DOUBLE AS worst_day, episodes,
        round(mean_days, 6) AS mean_episode_days, round(days / sum(days) OVER (PARTITION BY series_id), 6) AS share FROM rs JOIN es USING (series_id, label)""",
    )
)
def regime_summary(spark, sf_dir):
    """What each series did in each regime."""
    rows = reports.regime_summary(indicators.with_returns(panels.bars6(spark, sf_dir)), labels5(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in ("ann_return", "ann_volatility", "sharpe_ratio", "worst_day", "mean_episode_days", "share")})


@query(
    q.with_(
        q.LABELS,
        """num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM labels5),
        cut AS (SELECT *, greatest(1, least(floor(n * 0.7 + 1e-9), n - 1)) AS s FROM num),
        hv AS (SELECT series_id, label, 'in_sample' AS half FROM cut WHERE pos <= s UNION ALL SELECT series_id, label, 'out_of_sample' FROM cut WHERE pos >= s)""",
        select="""SELECT series_id, half, label, count(*) AS days, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id, half), 6) AS share
        FROM hv WHERE label <> -1 GROUP BY series_id, half, label""",
    )
)
def regime_mix(spark, sf_dir):
    """Shares of the labels in and out of sample."""
    rows = validation.halves(labels5(spark, sf_dir), 0.7, ["series_id"])
    return reports.regime_mix(rows, ["series_id", "half"]).withColumn("share", F.round("share", 6))


@query(
    q.with_(
        q.LABELS,
        MONTH_ENDS,
        """m1 AS (SELECT l.series_id, l.date, l.label, (SELECT max(e.date) FROM ends e WHERE e.series_id = l.series_id AND e.date < l.date) AS t0 FROM labels5 l),
        m2 AS (SELECT series_id, t0, label, count(*) AS n, max(date) AS latest FROM m1 WHERE t0 IS NOT NULL AND label <> -1 GROUP BY ALL)""",
        select="SELECT series_id, t0, label AS y FROM m2 QUALIFY row_number() OVER (PARTITION BY series_id, t0 ORDER BY n DESC, latest DESC) = 1",
    )
)
def modal_month_regime(spark, sf_dir):
    """Each month's most frequent label, by decision date."""
    bars = panels.bars6(spark, sf_dir)
    return learning.modal_labels(labels5(spark, sf_dir), indicators.month_ends(bars))


@query(
    q.with_(
        q.LABELS,
        select="""SELECT a.series_id, count(*) AS days, round(avg((a.label = b.label)::INT), 6) AS agreement FROM rules a JOIN labels5 b USING (series_id, date)
        WHERE a.label <> -1 AND b.label <> -1 GROUP BY a.series_id""",
    )
)
def label_agreement(spark, sf_dir):
    """How often raw and confirmed labels agree."""
    raw = regimes.rules_labels(features(spark, sf_dir))
    return regimes.agreement(raw, regimes.confirmed(raw, 5)).withColumn("agreement", F.round("agreement", 6))


@query(
    q.with_(
        q.LABELS,
        """ce AS (SELECT l.series_id, l.label, avg(vol_20d) AS vol, avg(trend_60d) AS trend, avg(vol_percentile) AS level FROM labels5 l JOIN feats USING (series_id, date) WHERE l.label <> -1 GROUP BY ALL),
        od AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY vol, label) - 1 AS nl,
          CASE WHEN level >= 0.66 THEN 'high' WHEN level >= 0.33 THEN 'mid' ELSE 'low' END || ' ' || CASE WHEN trend > 0.02 THEN 'up' WHEN trend < -0.02 THEN 'down' ELSE 'flat' END AS k FROM ce),
        nm AS (SELECT *, CASE k WHEN 'low up' THEN 'Calm Uptrend' WHEN 'low flat' THEN 'Quiet Range' WHEN 'low down' THEN 'Slow Bleed' WHEN 'mid up' THEN 'Steady Uptrend'
          WHEN 'mid flat' THEN 'Choppy' WHEN 'mid down' THEN 'Grinding Down' WHEN 'high up' THEN 'Volatile Rally' WHEN 'high flat' THEN 'Turbulent' ELSE 'Crisis / Selloff' END AS base FROM od)""",
        select="""SELECT series_id, nl::INT AS label, CASE WHEN count(*) OVER (PARTITION BY series_id, base) > 1 THEN base || ' (' || round(vol * 100)::INT || '% vol)' ELSE base END AS name,
        round(vol, 6) AS vol, round(trend, 6) + 0.0::DOUBLE AS trend, round(level, 6) AS level FROM nm""",
    )
)
def regime_names(spark, sf_dir):
    """Labels renumbered by volatility and named by their centroid."""
    rows = features(spark, sf_dir).select("series_id", "date", "vol_20d", "trend_60d", "vol_percentile")
    _, names = regimes.order_and_name(labels5(spark, sf_dir), rows)
    return names.withColumns({c: r6(c) for c in ("vol", "trend", "level")})


@query(
    q.with_(
        q.BARS,
        q.RETURNS,
        "up AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n, 1 / (1 + exp(-100 * round(r, 9))) AS p FROM rets WHERE r IS NOT NULL)",
        "ema(series_id, date, n, s) AS (SELECT series_id, date, n, p FROM up WHERE n = 1 UNION ALL SELECT up.series_id, up.date, up.n, ema.s * (1 - 2.0::DOUBLE / 6) + up.p * (2.0::DOUBLE / 6) FROM ema JOIN up ON up.series_id = ema.series_id AND up.n = ema.n + 1)",
        select=f"SELECT series_id, date, {q.r6('s')} AS p_up, (s > 1 - s)::INT AS label FROM ema",
    ).replace("WITH", "WITH RECURSIVE", 1)
)
def ema_probabilities(spark, sf_dir):
    """Exponentially weighted probabilities of a rise (a logistic function of the day's return), and the likelier label."""
    rows = indicators.with_returns(panels.bars6(spark, sf_dir)).where("r is not null")
    up = 1 / (1 + F.exp(-100 * F.round("r", 9)))
    rows = rows.select("series_id", "date", F.array(1 - up, up).alias("prob"))
    return regimes.smoothed_probabilities(rows).select("series_id", "date", r6(F.col("smooth_prob")[1]).alias("p_up"), "label")

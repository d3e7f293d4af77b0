"""Bootstrap intervals, corrected Sharpe ratios and errors under autocorrelation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.functions.columns import r6
from panelquant.operators import resampling

from . import sql as q
from .registry import query
from .runs import STACKED_CTES, sma_run, stacked_runs

REPLICATES, SEED = 2000, 7


def _uniform(tag: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:{tag}:' || rep || ':' || pos), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _index(block: float) -> str:
    return f"""
lens AS (SELECT DISTINCT n FROM arr), gr AS (SELECT n, rep, unnest(generate_series(0, n - 1)) AS pos FROM lens, (SELECT unnest(generate_series(0, {REPLICATES - 1})) AS rep)),
st AS (SELECT *, CASE WHEN pos = 0 OR {_uniform("restart")} < {1.0 / block}::DOUBLE THEN pos END AS p, CASE WHEN pos = 0 OR {_uniform("restart")} < {1.0 / block}::DOUBLE THEN floor({_uniform("start")} * n)::BIGINT END AS s FROM gr),
fx AS (SELECT n, rep, pos, last_value(p IGNORE NULLS) OVER w AS p, last_value(s IGNORE NULLS) OVER w AS s FROM st WINDOW w AS (PARTITION BY n, rep ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ix AS (SELECT n, rep, pos, (s + pos - p) % n AS idx FROM fx)"""


_RET = f"""
rr AS (SELECT series_id, date, coalesce(strategy_return, 0.0) AS ret, coalesce(daily_return, 0.0) AS bench, row_number() OVER ({q.S}) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM bt),
arr AS (SELECT DISTINCT series_id, n FROM rr)"""
_SMA_CTES = (q.BARS, q.SMA, q.backtest("sma"), _RET)


def _sharpe(mean: str, dev: str) -> str:
    return f"CASE WHEN {dev} > 1e-12 THEN {mean} / {dev} * sqrt(252) ELSE 0.0 END"


def _interval(block: float) -> str:
    return q.with_(
        *_SMA_CTES,
        _index(block),
        f"dr AS (SELECT r.series_id, rep, {_sharpe('avg(ret)', 'stddev_pop(ret)')} AS sh FROM ix JOIN rr r ON r.n = ix.n AND r.idx = ix.idx GROUP BY r.series_id, rep)",
        f"pt AS (SELECT series_id, {_sharpe('avg(ret)', 'stddev_samp(ret)')} AS point FROM rr GROUP BY series_id)",
        select="""SELECT series_id, round(any_value(point), 6) + 0.0::DOUBLE AS sharpe_point, round(quantile_cont(sh, 0.05), 6) + 0.0::DOUBLE AS sharpe_low,
        round(quantile_cont(sh, 0.95), 6) + 0.0::DOUBLE AS sharpe_high FROM dr JOIN pt USING (series_id) GROUP BY series_id""",
    )


def _returns(spark, sf_dir) -> DataFrame:
    zero = F.lit(0.0)
    return sma_run(spark, sf_dir).withColumns({"ret": F.coalesce("strategy_return", zero), "bench": F.coalesce("daily_return", zero)})


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: r6(c) for c in rows.columns if c not in ("series_id", "run_id")})


@query(_interval(20.0))
def stationary_bootstrap_ci(spark, sf_dir):
    """Sharpe intervals from blocks of random length."""
    return _rounded(resampling.sharpe_interval(_returns(spark, sf_dir), ["series_id"], replicates=REPLICATES, seed=SEED))


@query(_interval(1.0))
def iid_bootstrap_ci(spark, sf_dir):
    """Sharpe intervals from independent draws."""
    return _rounded(resampling.sharpe_interval(_returns(spark, sf_dir), ["series_id"], replicates=REPLICATES, mean_block=1.0, seed=SEED))


@query(
    q.with_(
        *_SMA_CTES,
        _index(20.0),
        f"dr AS (SELECT r.series_id, rep, {_sharpe('avg(ret)', 'stddev_pop(ret)')} - {_sharpe('avg(bench)', 'stddev_pop(bench)')} AS gap FROM ix JOIN rr r ON r.n = ix.n AND r.idx = ix.idx GROUP BY r.series_id, rep)",
        select="""SELECT series_id, round(quantile_cont(gap, 0.025), 6) + 0.0::DOUBLE AS gap_low, round(quantile_cont(gap, 0.975), 6) + 0.0::DOUBLE AS gap_high,
        round(avg((gap <= 0)::INT), 6) + 0.0::DOUBLE AS share_not_better FROM dr GROUP BY series_id""",
    )
)
def paired_bootstrap_ci(spark, sf_dir):
    """Interval of the Sharpe difference to holding, over the same days."""
    return _rounded(resampling.paired_interval(_returns(spark, sf_dir), ["series_id"], "ret", "bench", REPLICATES, seed=SEED))


_LAGS = 5


@query(
    q.with_(
        *_SMA_CTES,
        "dm AS (SELECT *, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM rr)",
        "lg AS (SELECT *, " + ", ".join(f"lag(x, {k}) OVER ({q.S}) AS x{k}" for k in range(1, _LAGS + 1)) + " FROM dm)",
        select="SELECT series_id, round(sqrt(greatest((sum(x * x)"
        + "".join(f" + 2 * {1 - k / (_LAGS + 1)}::DOUBLE * coalesce(sum(x * x{k}), 0)" for k in range(1, _LAGS + 1))
        + ") / count(*), 0) / count(*)) * 1000, 6) + 0.0::DOUBLE AS se_thousandths, count(*) AS n_obs FROM lg GROUP BY series_id",
    )
)
def newey_west(spark, sf_dir):
    """Standard error of the mean daily return, in thousandths."""
    rows = resampling.newey_west(_returns(spark, sf_dir), ["series_id"], lags=_LAGS)
    return rows.select("series_id", r6(F.col("se") * 1000).alias("se_thousandths"), "n_obs")


_TRIALS = 11


@query(
    q.with_(
        *STACKED_CTES,
        """mo AS (SELECT run_id, series_id, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS s, stddev_pop(ret) AS sp, avg(ret * ret) AS m2, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4
          FROM (SELECT run_id, series_id, coalesce(strategy_return, 0.0) AS ret FROM bt) GROUP BY ALL),
        sk AS (SELECT *, CASE WHEN s > 1e-12 THEN m / s ELSE 0.0 END AS sr, (m3 - 3 * m * m2 + 2 * m ** 3) / sp ** 3 AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / sp ** 4 AS kurt FROM mo)""",
        select=f"""SELECT run_id, series_id, n AS n_obs, round(sr, 6) + 0.0::DOUBLE AS sharpe, round(skew, 5) + 0.0::DOUBLE AS skew, round(kurt, 5) + 0.0::DOUBLE AS kurtosis,
        round((sr - {resampling.expected_best(_TRIALS)!r}::DOUBLE / sqrt(n - 1)) / sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)), 5) + 0.0::DOUBLE AS z FROM sk""",
    )
)
def deflated_sharpe(spark, sf_dir):
    """How far each run's Sharpe stands above the best of eleven lucky ones."""
    rows = stacked_runs(spark, sf_dir)[2].withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    out = resampling.deflated_z(resampling.moments(rows, ["run_id", "series_id"]), _TRIALS)
    fine = {c: F.round(c, 5) + F.lit(0.0) for c in ("skew", "kurtosis", "z")}
    return out.withColumns({"sharpe": r6("sharpe"), **fine})


@query()
def deflated_sharpe_probability(spark, sf_dir):
    """The same as probabilities; SQL has no normal distribution."""
    rows = stacked_runs(spark, sf_dir)[2].withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    out = resampling.deflated_z(resampling.moments(rows, ["run_id", "series_id"]), _TRIALS)
    return out.select("run_id", "series_id", r6(resampling.normal_cdf("z")).alias("dsr"))


@query(
    q.with_(
        *STACKED_CTES,
        """tr AS (SELECT run_id, series_id, trials, avg(ret) / stddev_samp(ret) AS sr, count(*) AS n FROM (SELECT run_id, series_id, coalesce(strategy_return, 0.0) AS ret FROM bt),
          (SELECT unnest([2, 5, 11, 50]) AS trials) GROUP BY ALL)""",
        select="SELECT run_id, series_id, trials, round(sr - CASE trials "
        + " ".join(f"WHEN {t} THEN {resampling.expected_best(t)!r}::DOUBLE" for t in (2, 5, 11, 50))
        + " END / sqrt(n - 1), 6) + 0.0::DOUBLE AS excess FROM tr",
    )
)
def trial_count_sweep(spark, sf_dir):
    """Excess of each Sharpe over the luck of more and more trials."""
    rows = stacked_runs(spark, sf_dir)[2].withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    stats = resampling.moments(rows, ["run_id", "series_id"])
    bars = {t: resampling.expected_best(t) for t in (2, 5, 11, 50)}
    sweep = F.explode(F.array(*[F.struct(F.lit(t).alias("trials"), F.lit(b).alias("bar")) for t, b in bars.items()]))
    rows = stats.withColumn("t", sweep)
    return rows.select("run_id", "series_id", "t.trials", r6(F.col("sharpe") - F.col("t.bar") / F.sqrt(F.col("n_obs") - 1)).alias("excess"))

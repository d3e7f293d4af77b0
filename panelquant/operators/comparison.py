"""Strategies side by side: one table that a failing strategy doesn't take down, and test folds stitched into one curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import run_backtest
from .reports import full_report
from .resampling import deflated_z, moments, normal_cdf
from .signals import CATALOG, constant
from .validation import halves, rolling_folds

BENCHMARK = "buy_and_hold"
MEASURES = ("is_sharpe", "oos_sharpe", "sharpe_decay", "oos_return", "oos_max_dd", "oos_exposure", "turnover", "z")


def attempted(bars: DataFrame, runs: Sequence[tuple[str, str, dict]]) -> tuple[DataFrame, dict[str, str]]:
    """Signals of the runs (run id, strategy, parameters) whose plan can be built, the benchmark's among them, and the errors of the others.

    Errors are those of building a plan: unknown strategies or parameters, wrong types, missing columns. What fails in a task fails the job.
    """
    out, errors = constant(bars).withColumn("run_id", F.lit(BENCHMARK)), {}
    names = [run_id for run_id, _, _ in runs]
    if len(set(names)) < len(names) or BENCHMARK in names:
        raise ValueError(f"run ids must differ from each other and from {BENCHMARK}")
    for run_id, name, parameters in runs:
        try:
            own = CATALOG[name].signals(bars, **parameters).withColumn("run_id", F.lit(run_id))
            out = out.unionByName(own)
        except Exception as error:  # a strategy's code may fail in any way; the row tells how
            errors[run_id] = f"{type(error).__name__}: {error}".strip().splitlines()[0]
    return out.select("run_id", "series_id", "date", "signal"), errors


def comparison(bars: DataFrame, runs: Sequence[tuple[str, str, dict]], share: float = 0.7, cost_bps: float = 5.0) -> DataFrame:
    """One row a run and series, the benchmark's too: measures before and after the split, and the deflated Sharpe against buying and holding.

    ``z`` is how far the out-of-sample Sharpe stands above the benchmark's over the same days and the luck of as many
    candidates as were tried (failed ones count); ``deflated_sharpe`` is its probability, null for the benchmark. A run
    without a plan has null measures and its ``error``. Sorted by ``z``, nulls last.
    """
    signals, errors = attempted(bars, runs)
    parts = halves(run_backtest(bars, signals, cost_bps), share)
    reported = full_report(parts, ["run_id", "series_id", "half"])
    of = lambda column, half: F.max(F.when(F.col("half") == half, F.col(column)))
    named = {"oos_sharpe": "sharpe_ratio", "oos_return": "total_return", "oos_max_dd": "max_drawdown", "oos_exposure": "exposure", "turnover": "turnover"}
    wide = reported.groupBy("run_id", "series_id").agg(
        of("sharpe_ratio", "in_sample").alias("is_sharpe"), *[of(c, "out_of_sample").alias(name) for name, c in named.items()]
    )
    wide = wide.withColumn("sharpe_decay", F.col("is_sharpe") - F.col("oos_sharpe"))
    later = parts.where("half = 'out_of_sample'").withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    stats = moments(later, ["run_id", "series_id"])
    held = stats.where(F.col("run_id") == BENCHMARK).select("series_id", F.col("sharpe").alias("held"))
    scored = deflated_z(stats.where(F.col("run_id") != BENCHMARK).join(held, "series_id"), len(runs), F.col("held"))
    rows = wide.join(scored.select("run_id", "series_id", "z"), ["run_id", "series_id"], "left").withColumn("error", F.lit(None).cast("string"))
    if errors:
        failed = F.explode(F.array(*[F.struct(F.lit(k).alias("run_id"), F.lit(v).alias("error")) for k, v in errors.items()]))
        rows = rows.unionByName(bars.select("series_id").distinct().select("series_id", failed.alias("f")).select("series_id", "f.*"), allowMissingColumns=True)
    rows = rows.withColumns({"n_trials": F.lit(len(runs)), "deflated_sharpe": normal_cdf("z")})
    rows = rows.select("run_id", "series_id", *MEASURES, "n_trials", "deflated_sharpe", "error")
    return rows.orderBy(F.desc_nulls_last("z"), "run_id", "series_id")


def stitched_report(backtest: DataFrame, train: int = 756, test: int = 126, oos_from: Column | None = None, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """A full report of the test rows of all scorable folds as one curve, with ``folds``, ``scored`` and the mean, worst and positive share of their Sharpes.

    A fold is scorable if it starts on or after the first out-of-sample day (``oos_from``, a column of the backtest); without
    one, all are. Gaps between folds that can't be scored are closed up. A key without a scorable fold has no row.
    """
    keys = list(keys)
    rows = rolling_folds(backtest.withColumn("oos", F.lit(None).cast("date") if oos_from is None else oos_from), train, test, keys)
    starts = rows.groupBy(*keys, "fold").agg(F.min("date").alias("start"), F.max("oos").alias("oos"))
    able = F.col("oos").isNull() | (F.col("start") >= F.col("oos"))
    folds = starts.select(*keys, "fold", able.alias("able"))
    counts = folds.groupBy(*keys).agg(F.count("*").alias("folds"), F.count_if("able").alias("scored"))
    tested = rows.join(folds.where("able"), [*keys, "fold"], "left_semi")
    each = full_report(tested, [*keys, "fold"]).groupBy(*keys).agg(
        F.avg("sharpe_ratio").alias("mean_sharpe"), F.min("sharpe_ratio").alias("worst_sharpe"), F.avg((F.col("sharpe_ratio") > 0).cast("double")).alias("share_positive")
    )
    return full_report(tested, keys).join(counts, keys).join(each, keys)

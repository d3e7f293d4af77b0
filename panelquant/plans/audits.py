"""Checks of datasets, folds, predictions and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelquant.functions.columns import r6
from panelquant.operators import audits, backtest, learning, regimes, reports, signals, validation
from panelquant.sources import panels

from . import sql as q
from .models import _FIT, _FOLDS, _HEAD, _cond_sql, _conditional, _fit_rows, _monthly
from .registry import query
from .runs import DAILY_COLUMNS
from .studies import _REFIT


@query(
    _cond_sql(
        """SELECT series_id, y, count(*) FILTER (NOT p > 0.5) AS predicted_0, count(*) FILTER (p > 0.5) AS predicted_1 FROM cp GROUP BY series_id, y"""
    )
)
def confusion_matrix(spark, sf_dir):
    """Months by direction and by the direction that the previous month suggests."""
    rows = _conditional(spark, sf_dir).withColumn("predicted", (F.col("proba")[1] > 0.5).cast("int"))
    out = learning.confusion(rows, [0, 1], ["series_id"])
    return out.withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


@query(q.with_(*_HEAD, select="SELECT series_id, y, count(*) AS months, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM monthly GROUP BY series_id, y"))
def label_balance(spark, sf_dir):
    """How often each direction occurs."""
    return audits.label_balance(learning.monthly_dataset(panels.bars6(spark, sf_dir))).withColumn("share", F.round("share", 6))


_PLAIN = "greatest(ps.b, 0.0001) / (greatest(ps.a, 0.0001) + greatest(ps.b, 0.0001))"


@query(
    _cond_sql(
        f"""SELECT series_id, fold, count(*) AS months, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss,
        round(avg(-ln(CASE WHEN y = 1 THEN {_PLAIN} ELSE 1 - {_PLAIN} END)), 6) AS reference_log_loss
        FROM cp JOIN ps USING (series_id, fold) GROUP BY series_id, fold"""
    )
)
def fold_scores(spark, sf_dir):
    """Log loss of each fold, and that of the training shares alone."""
    _, rows = _monthly(spark, sf_dir)
    prior = learning.prior_probabilities(rows.where("role = 'train'"), [0, 1], ["series_id", "fold"]).withColumnRenamed("proba", "plain")
    out = audits.fold_scores(_conditional(spark, sf_dir).join(prior, ["series_id", "fold"]), "proba", "plain", ["series_id", "fold"])
    return out.withColumns({c: F.round(c, 6) for c in ("log_loss", "reference_log_loss")})


_SAME_FOLDS = (
    q.BARS,
    q.MOMENTUM,
    q.backtest("mom", "fx"),
    "fy AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS total FROM fx)",
    "ff AS (SELECT *, floor((pos - 756) / 126)::INT AS fold FROM fy WHERE pos >= 756 AND 756 + (floor((pos - 756) / 126) + 1) * 126 <= total)",
    q.report("ff", "series_id, fold", "rf"),
    _REFIT,
    q.backtest("fs"),
    "ft AS (SELECT * FROM bt WHERE is_test)",
    q.report("ft", "source, fold", "rr"),
    """df AS (SELECT rf.series_id, rf.fold, round(rf.sharpe_ratio, 6) + 0.0::DOUBLE AS fixed_sharpe, round(rr.sharpe_ratio, 6) + 0.0::DOUBLE AS refit_sharpe,
      round(rf.sharpe_ratio - rr.sharpe_ratio, 6) + 0.0::DOUBLE AS delta FROM rf JOIN rr ON rf.series_id = rr.source AND rf.fold = rr.fold)""",
)


def _same_folds(spark, sf_dir):
    bars = panels.bars6(spark, sf_dir).select("series_id", "date", "close")
    fixed = validation.rolling_folds(backtest.run_backtest(bars, signals.momentum(bars).select("series_id", "date", "signal")), keys=["series_id"])
    own = validation.refit_signals(bars, signals.momentum).withColumn("source", F.col("series_id"))
    own = own.withColumn("series_id", F.concat_ws("#", "series_id", "fold"))
    tested = backtest.run_backtest(own.select("series_id", "date", "close"), own.select("series_id", "date", "signal"))
    tested = tested.join(own.select("series_id", "date", "is_test", "fold", "source"), ["series_id", "date"]).where("is_test")
    refit = reports.full_report(tested, ["source", "fold"]).withColumnRenamed("source", "series_id")
    out = audits.paired_folds(reports.full_report(fixed, ["series_id", "fold"]), refit, "sharpe_ratio")
    return out.select("series_id", "fold", r6("first").alias("fixed_sharpe"), r6("second").alias("refit_sharpe"), r6("delta").alias("delta"))


@query(q.with_(*_SAME_FOLDS, select="SELECT * FROM df ORDER BY delta DESC, series_id, fold"))
def refit_against_fixed(spark, sf_dir):
    """Folds of one backtest and of strategies built anew on each, the same folds side by side, by their difference."""
    return _same_folds(spark, sf_dir).orderBy(F.desc("delta"), "series_id", "fold")


@query(q.with_(*_SAME_FOLDS, select="SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY delta DESC, fold) <= 3"))
def most_overstated_folds(spark, sf_dir):
    """The three folds of a series that the fixed backtest flatters most."""
    return audits.largest(_same_folds(spark, sf_dir), ["series_id"], [F.desc("delta"), F.asc("fold")], 3)


@query(
    q.with_(
        *_HEAD,
        _FOLDS,
        """tw AS (SELECT series_id, fold, min(t0) AS s, max(t1) AS e, count(*) AS n FROM mr WHERE role = 'test' GROUP BY ALL)""",
        select="""SELECT r.series_id, r.fold, any_value(n) AS test_rows, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'purged') AS purged_rows,
        count(*) FILTER (role = 'train' AND t1 >= s AND t0 <= e) AS overlapping, count(*) FILTER (role = 'train' AND t0 >= s) AS later
        FROM mr r JOIN tw ON r.series_id = tw.series_id AND r.fold = tw.fold GROUP BY r.series_id, r.fold""",
    )
)
def leakage_counts(spark, sf_dir):
    """Training rows of each fold whose label reaches into its test span, or that start in it or later; both should be 0."""
    _, rows = _monthly(spark, sf_dir)
    return audits.leakage_counts(rows, ["series_id", "fold"])


@query(
    q.with_(
        *_HEAD,
        "en AS (SELECT series_id, min(t0) AS a, max(t1) AS b, count(*) AS months, product(1 + forward_return) - 1 AS compounded FROM monthly GROUP BY series_id)",
        select="""SELECT en.series_id, months, round(compounded, 6) + 0.0::DOUBLE AS compounded, round(y.close / x.close - 1, 6) + 0.0::DOUBLE AS by_prices, abs(compounded - (y.close / x.close - 1)) < 1e-9 AS agrees
        FROM en JOIN bars x ON x.series_id = en.series_id AND x.date = a JOIN bars y ON y.series_id = en.series_id AND y.date = b""",
    )
)
def return_cross_check(spark, sf_dir):
    """Compounded monthly returns against the first and last price."""
    bars = panels.bars6(spark, sf_dir)
    out = audits.return_cross_check(learning.monthly_dataset(bars), bars)
    return out.withColumns({c: r6(c) for c in ("compounded", "by_prices")})


@query(
    q.with_(
        *_HEAD,
        _FOLDS,
        "pr AS (SELECT series_id, t0, 'previous' AS model FROM mr WHERE role = 'test' UNION ALL SELECT series_id, t0, 'hold' FROM mr WHERE role = 'test')",
        select="""SELECT series_id, sum(n)::BIGINT AS predictions, count(*) AS keys, count(*) FILTER (n > 1) AS repeated
        FROM (SELECT series_id, t0, model, count(*) AS n FROM pr GROUP BY ALL) GROUP BY series_id""",
    )
)
def prediction_keys(spark, sf_dir):
    """Whether the predictions of two baselines, put together, have one row for each series, month and model."""
    _, rows = _monthly(spark, sf_dir)
    rows = rows.where("role = 'test'").select("series_id", "t0")
    both = rows.withColumn("model", F.lit("previous")).unionByName(rows.withColumn("model", F.lit("hold")))
    return audits.key_counts(both, ["series_id", "t0", "model"], ["series_id"])


@query()
def top_importances(spark, sf_dir):
    """The five features with the largest standardised coefficients of the direction model."""
    table = learning.daily_table(panels.bars6(spark, sf_dir)).cache()
    model = learning.train_direction(table, DAILY_COLUMNS)
    return audits.importances(spark, model, DAILY_COLUMNS).orderBy(F.desc(F.abs("importance")), "feature").limit(5)


@query()
def hmm_hindsight(spark, sf_dir):
    """Days on which smoothing and the best path, which know the whole series, name the state that filtering names."""
    _, fit = _fit_rows(spark, sf_dir)
    fit = fit.withColumn("model_id", F.col("series_id"))
    models = regimes.fit_hmm(fit, _FIT).cache()
    filtered = regimes.hmm_labels(fit, _FIT, models)
    out = None
    for method in ("smooth", "viterbi"):
        own = regimes.agreement(filtered, regimes.hmm_labels(fit, _FIT, models, method=method))
        own = own.select("series_id", F.lit(method).alias("method"), F.lit(False).alias("causal"), "days", r6("agreement").alias("agreement"))
        out = own if out is None else out.unionByName(own)
    return out

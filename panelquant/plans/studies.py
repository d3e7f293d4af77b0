"""Validation studies and strategies that adapt to regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.functions.columns import correlation, r6
from panelquant.operators import adaptive, backtest, indicators, learning, ml_signals, reports, signals, validation
from panelquant.sources import panels

from . import sql as q
from .labels import labels5
from .registry import query
from .runs import STACKED_CTES, stacked_runs

_SPLIT = """
num AS (SELECT *, row_number() OVER (PARTITION BY run_id, series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY run_id, series_id) AS total FROM bt),
cut AS (SELECT *, greatest(1, least(floor(total * 0.7 + 1e-9), total - 1)) AS s FROM num),
hv AS (SELECT *, 'in_sample' AS half FROM cut WHERE pos <= s UNION ALL SELECT *, 'out_of_sample' FROM cut WHERE pos >= s)"""


def _reported(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: r6(c) for c in q.REPORT_COLUMNS})


@query(q.with_(*STACKED_CTES, _SPLIT, q.report("hv", "run_id, series_id, half"), select=f"SELECT run_id, series_id, half, {q.REPORT_SELECT} FROM rep"))
def oos_split_report(spark, sf_dir):
    """In-sample and out-of-sample reports of every run."""
    return _reported(validation.evaluate_out_of_sample(stacked_runs(spark, sf_dir)[2]))


@query(
    q.with_(
        *STACKED_CTES,
        _SPLIT,
        q.report("hv", "run_id, series_id, half"),
        select="""SELECT run_id, round(avg(CASE WHEN half = 'in_sample' THEN sharpe_ratio END), 6) + 0.0::DOUBLE AS is_sharpe,
        round(avg(CASE WHEN half = 'out_of_sample' THEN sharpe_ratio END), 6) + 0.0::DOUBLE AS oos_sharpe, count(*) AS parts FROM rep GROUP BY run_id ORDER BY oos_sharpe DESC NULLS LAST""",
    )
)
def compare_strategies(spark, sf_dir):
    """Strategies by their mean out-of-sample Sharpe."""
    rows = validation.evaluate_out_of_sample(stacked_runs(spark, sf_dir)[2])
    value = lambda half: r6(F.avg(F.when(F.col("half") == half, F.col("sharpe_ratio"))))
    rows = rows.groupBy("run_id").agg(value("in_sample").alias("is_sharpe"), value("out_of_sample").alias("oos_sharpe"), F.count("*").alias("parts"))
    return rows.orderBy(F.col("oos_sharpe").desc_nulls_last())


@query(
    q.with_(
        *STACKED_CTES,
        _SPLIT,
        q.report("hv", "run_id, series_id, half"),
        """pr AS (SELECT run_id, series_id, round(max(CASE WHEN half = 'in_sample' THEN sharpe_ratio END), 6) AS a, round(max(CASE WHEN half = 'out_of_sample' THEN sharpe_ratio END), 6) AS b FROM rep GROUP BY ALL),
        rk AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY a) + (count(*) OVER (PARTITION BY series_id, a) - 1) / 2 AS ra,
          rank() OVER (PARTITION BY series_id ORDER BY b) + (count(*) OVER (PARTITION BY series_id, b) - 1) / 2 AS rb FROM pr)""",
        select="SELECT series_id, count(*) AS runs, round(CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-14 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END, 6) + 0.0::DOUBLE AS rank_correlation FROM rk GROUP BY series_id",
    )
)
def rank_correlation(spark, sf_dir):
    """Spearman correlation of in-sample and out-of-sample Sharpe over the runs of a series."""
    from pyspark.sql import Window

    rows = validation.evaluate_out_of_sample(stacked_runs(spark, sf_dir)[2])
    wide = rows.groupBy("run_id", "series_id").agg(
        *[F.round(F.max(F.when(F.col("half") == h, F.col("sharpe_ratio"))), 6).alias(c) for h, c in (("in_sample", "a"), ("out_of_sample", "b"))]
    )
    rank = lambda c: F.rank().over(Window.partitionBy("series_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("series_id", c)) - 1) / 2
    wide = wide.withColumns({"ra": rank("a"), "rb": rank("b")})
    return wide.groupBy("series_id").agg(F.count("*").alias("runs"), r6(correlation("ra", "rb")).alias("rank_correlation"))


_FOLDS = """
num AS (SELECT *, row_number() OVER (PARTITION BY run_id, series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY run_id, series_id) AS total FROM bt),
folds AS (SELECT *, floor((pos - 756) / 126)::INT AS fold FROM num WHERE pos >= 756 AND 756 + (floor((pos - 756) / 126) + 1) * 126 <= total)"""


@query(q.with_(*STACKED_CTES, _FOLDS, q.report("folds", "run_id, series_id, fold"), select=f"SELECT run_id, series_id, fold, {q.REPORT_SELECT} FROM rep"))
def rolling_folds_fixed(spark, sf_dir):
    """One backtest reported by rolling test folds."""
    rows = validation.rolling_folds(stacked_runs(spark, sf_dir)[2], keys=["run_id", "series_id"])
    return _reported(reports.full_report(rows, ["run_id", "series_id", "fold"]))


@query(
    q.with_(
        *STACKED_CTES,
        _FOLDS,
        q.report("folds", "run_id, series_id, fold"),
        select="""SELECT run_id, series_id, count(*) AS folds, round(avg(sharpe_ratio), 6) + 0.0::DOUBLE AS mean_sharpe, round(median(sharpe_ratio), 6) + 0.0::DOUBLE AS median_sharpe,
        round(stddev_samp(sharpe_ratio), 6) + 0.0::DOUBLE AS std_sharpe, round(min(sharpe_ratio), 6) + 0.0::DOUBLE AS worst_sharpe, round(avg((sharpe_ratio > 0)::INT), 6) AS share_positive
        FROM rep WHERE exposure > 0 GROUP BY run_id, series_id""",
    )
)
def fold_summary(spark, sf_dir):
    """Sharpe over the folds in which a position was held."""
    rows = validation.rolling_folds(stacked_runs(spark, sf_dir)[2], keys=["run_id", "series_id"])
    rows = reports.full_report(rows, ["run_id", "series_id", "fold"]).withColumn("can_hold", F.col("exposure") > 0)
    out = validation.fold_summary(rows, ["run_id", "series_id"])
    return out.withColumns({c: r6(c) for c in ("mean_sharpe", "median_sharpe", "std_sharpe", "worst_sharpe", "share_positive")})


_REFIT = f"""
nb AS (SELECT *, row_number() OVER ({q.S}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS total FROM bars),
fl AS (SELECT nb.series_id AS source, nb.series_id || '#' || f AS series_id, f AS fold, date, close, pos >= f * 126 + 756 AS is_test
  FROM nb, (SELECT unnest(generate_series(0, 60)) AS f) WHERE f < greatest(floor((total - 756) / 126), 0) AND pos >= f * 126 AND pos < f * 126 + 756 + 126),
fs AS (SELECT *, CASE WHEN close / lag(close, 20) OVER ({q.S}) - 1 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM fl)"""


@query(q.with_(q.BARS, _REFIT, q.backtest("fs"), "ft AS (SELECT * FROM bt WHERE is_test)", q.report("ft", "source, fold"), select=f"SELECT source AS series_id, fold, {q.REPORT_SELECT} FROM rep"))
def rolling_folds_refit(spark, sf_dir):
    """The momentum strategy built anew on each fold's rows, reported on its test rows."""
    bars = panels.bars6(spark, sf_dir).select("series_id", "date", "close")
    rows = validation.refit_signals(bars, signals.momentum)
    own = rows.withColumn("run_id", F.col("series_id")).withColumn("series_id", F.concat_ws("#", "series_id", "fold"))
    tested = backtest.run_backtest(own.drop("run_id", "signal"), own.select("series_id", "date", "signal"))
    tested = tested.join(own.select("series_id", "date", "is_test", "fold", F.col("run_id").alias("source")), ["series_id", "date"]).where("is_test")
    out = _reported(reports.full_report(tested, ["source", "fold"]))
    return out.withColumnRenamed("source", "series_id")


_LAB = ",".join([q.LABELS, q.SMA, q.MOMENTUM, q.RSI, """
runs AS (SELECT 'sma' AS run_id, * FROM sma UNION ALL SELECT 'momentum', * FROM mom UNION ALL SELECT 'rsi', * FROM revert UNION ALL SELECT 'hold', series_id, date, close, 1.0::DOUBLE FROM bars)"""])  # fmt: skip
_EVIDENCE = f"""
le1 AS (SELECT series_id, date, row_number() OVER ({q.S}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, lead(date) OVER ({q.S}) AS nx FROM bars),
le AS (SELECT series_id, date AS learn_end, nx AS oos_from FROM le1 WHERE pos = greatest(floor(n * 0.5) - 1, 0)),
ev0 AS (SELECT b.run_id, b.series_id, l.label, coalesce(strategy_return, 0.0) AS ret FROM bt b JOIN labels5 l USING (series_id, date) JOIN le USING (series_id) WHERE l.label <> -1 AND b.date <= learn_end),
ev AS (SELECT series_id, label, run_id, count(*) AS days, CASE WHEN count(*) >= 60 THEN round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) END AS sharpe FROM ev0 GROUP BY ALL),
best AS (SELECT series_id, label, CASE WHEN sharpe IS NULL THEN NULL WHEN sharpe <= 0 THEN 'flat' ELSE run_id END AS choice, sharpe, days FROM ev
  QUALIFY row_number() OVER (PARTITION BY series_id, label ORDER BY sharpe DESC NULLS LAST, run_id) = 1)"""
_ADAPT = (_LAB, q.backtest("runs", keys="run_id, series_id"), _EVIDENCE)


def _learned(spark, sf_dir):
    bars = panels.bars6(spark, sf_dir)
    labels = labels5(spark, sf_dir)
    runs = stacked_runs(spark, sf_dir)[1]
    ends = adaptive.learn_ends(bars)
    table = adaptive.evidence(bars, labels, runs, ends).withColumn("sharpe", F.round("sharpe", 6))
    return bars, labels, runs, ends, table


@query(q.with_(*_ADAPT, select="SELECT series_id, label, run_id, days, sharpe + 0.0::DOUBLE AS sharpe FROM ev"))
def regime_evidence(spark, sf_dir):
    """Sharpe of each candidate in each regime up to the learning cutoff."""
    return _learned(spark, sf_dir)[4].withColumn("sharpe", F.col("sharpe") + F.lit(0.0))


@query(q.with_(*_ADAPT, select="SELECT series_id, label, choice, days FROM best"))
def regime_choices(spark, sf_dir):
    """The strategy chosen for each regime."""
    return adaptive.best_per_regime(_learned(spark, sf_dir)[4]).drop("sharpe")


@query(
    q.with_(
        *_ADAPT,
        "mg AS (SELECT *, lead(sharpe) OVER w AS second, row_number() OVER w AS place FROM ev WHERE sharpe IS NOT NULL WINDOW w AS (PARTITION BY series_id, label ORDER BY sharpe DESC, run_id))",
        select="""SELECT series_id, label, run_id AS winner, round(sharpe - second, 6) + 0.0::DOUBLE AS margin, round(sqrt(252.0 / days), 6) AS noise,
        coalesce(sharpe - second > sqrt(252.0 / days), false) AS decisive FROM mg WHERE place = 1""",
    )
)
def choice_margins(spark, sf_dir):
    """Whether the choices are decisive."""
    rows = adaptive.margins(_learned(spark, sf_dir)[4])
    return rows.withColumns({"margin": r6("margin"), "noise": F.round("noise", 6)})


_SWITCH = """
sw AS (SELECT l.series_id, l.date, b.close, CASE WHEN l.date >= le.oos_from THEN coalesce(r.signal, 0.0) ELSE 0.0 END::DOUBLE AS signal
  FROM labels5 l JOIN bars b USING (series_id, date) JOIN le USING (series_id) LEFT JOIN best ON best.series_id = l.series_id AND best.label = l.label
  LEFT JOIN runs r ON r.series_id = l.series_id AND r.date = l.date AND r.run_id = best.choice)"""


@query(q.with_(*_ADAPT, _SWITCH, q.backtest("sw", "st"), q.report("st", "series_id"), select=f"SELECT series_id, {q.REPORT_SELECT} FROM rep"))
def regime_switch(spark, sf_dir):
    """Each day the strategy chosen for its regime."""
    bars, labels, runs, ends, table = _learned(spark, sf_dir)
    switched = adaptive.regime_switch(runs, labels, adaptive.best_per_regime(table), ends)
    return _reported(reports.full_report(backtest.run_backtest(bars, switched), ["series_id"]))


_FILTER = """
fi AS (SELECT s.series_id, s.date, s.close, CASE WHEN s.date >= le.oos_from AND e.sharpe > 0 THEN s.signal ELSE 0.0 END::DOUBLE AS signal
  FROM sma s JOIN le USING (series_id) LEFT JOIN labels5 l ON l.series_id = s.series_id AND l.date = s.date
  LEFT JOIN ev e ON e.series_id = s.series_id AND e.label = l.label AND e.run_id = 'sma')"""


@query(q.with_(*_ADAPT, _FILTER, q.backtest("fi", "st"), q.report("st", "series_id"), select=f"SELECT series_id, {q.REPORT_SELECT} FROM rep"))
def regime_filtered(spark, sf_dir):
    """The SMA crossover in the regimes where it has earned."""
    bars, labels, runs, ends, table = _learned(spark, sf_dir)
    kept = adaptive.regime_filtered(runs, labels, table, ends, "sma")
    return _reported(reports.full_report(backtest.run_backtest(bars, kept), ["series_id"]))


@query(
    q.with_(
        *_ADAPT,
        _FILTER,
        select="""SELECT s.series_id, CASE WHEN coalesce(l.label, -1) = -1 THEN 'warm_up' ELSE 'excluded_regime' END AS cause, count(*) AS days
        FROM sma s JOIN fi USING (series_id, date) LEFT JOIN labels5 l USING (series_id, date) WHERE s.signal <> 0 AND fi.signal = 0 GROUP BY ALL""",
    )
)
def filter_override_days(spark, sf_dir):
    """Days on which the filter overrides its base, by cause."""
    bars, labels, runs, ends, table = _learned(spark, sf_dir)
    base = runs.where("run_id = 'sma'")
    return adaptive.override_days(base, adaptive.regime_filtered(runs, labels, table, ends, "sma"), labels)


_SIZED = """
vo AS (SELECT r.series_id, l.label, stddev_samp(r) AS vol FROM rets r JOIN labels5 l USING (series_id, date) JOIN le USING (series_id) WHERE l.label <> -1 AND r.date <= learn_end GROUP BY ALL),
sz AS (SELECT *, min(vol) OVER (PARTITION BY series_id) / nullif(vol, 0) AS size FROM vo),
si AS (SELECT b.series_id, b.date, b.close, CASE WHEN b.date >= le.oos_from THEN round(coalesce(sz.size, 0.0), 8) ELSE 0.0 END::DOUBLE AS signal
  FROM bars b JOIN le USING (series_id) LEFT JOIN labels5 l ON l.series_id = b.series_id AND l.date = b.date LEFT JOIN sz ON sz.series_id = b.series_id AND sz.label = l.label)"""


@query(q.with_(*_ADAPT, _SIZED, q.backtest("si", "st"), q.report("st", "series_id"), select=f"SELECT series_id, {q.REPORT_SELECT} FROM rep"))
def regime_sized(spark, sf_dir):
    """Holding, sized by each regime's learned volatility."""
    bars, labels, runs, ends, _ = _learned(spark, sf_dir)
    sized = adaptive.regime_sized(bars, runs.where("run_id = 'hold'"), labels, ends).withColumn("signal", F.round("signal", 8))
    return _reported(reports.full_report(backtest.run_backtest(bars, sized), ["series_id"]))


# Splits ------------------------------------------------------------------------------------------------------

_MONTHS = """
mt AS (SELECT series_id, date, close, volume FROM bars WHERE (series_id, date) IN (SELECT (series_id, date) FROM ends)),
samples AS (SELECT series_id, date AS t0, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS t1, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM mt),
sm AS (SELECT * FROM samples WHERE t1 IS NOT NULL)"""


def _samples(spark, sf_dir) -> DataFrame:
    from panelquant.functions.columns import ordered

    ends = indicators.month_ends(panels.bars6(spark, sf_dir))
    return ends.select("series_id", F.col("date").alias("t0"), F.lead("date").over(ordered()).alias("t1")).where("t1 is not null")


def _roles_sql(spans: str, embargo: int, only: str) -> str:
    return f"""
{spans},
roles AS (SELECT sm.series_id, fold, sm.t0, CASE WHEN sm.pos BETWEEN a AND b THEN 'test' WHEN sm.t0 <= e AND sm.t1 >= s THEN 'purged'
  WHEN sm.pos BETWEEN b + 1 AND b + {embargo} THEN 'embargoed' ELSE 'train' END AS role FROM sm JOIN sp USING (series_id) WHERE {only})
SELECT series_id, fold, min(CASE WHEN role = 'test' THEN t0 END) AS test_start, max(CASE WHEN role = 'test' THEN t0 END) AS test_end,
  count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'purged') AS n_purged, count(*) FILTER (role = 'embargoed') AS n_embargoed
FROM roles GROUP BY series_id, fold"""


from .runs import MONTH_ENDS  # noqa: E402

_SPAN = "min(pos) AS a, max(pos) AS b, min(t0) AS s, max(t1) AS e"


@query("WITH " + ",".join([q.BARS, MONTH_ENDS, _MONTHS]) + "," + _roles_sql(f"""st AS (SELECT x.series_id, min(x.pos) AS start FROM sm x WHERE x.pos >= 36 AND (SELECT count(*) FROM sm y WHERE y.series_id = x.series_id AND y.t1 < x.t0) >= 36 GROUP BY 1),
sp AS (SELECT series_id, floor((pos - start) / 12)::INT AS fold, {_SPAN} FROM sm JOIN st USING (series_id) WHERE pos >= start GROUP BY 1, 2)""", 0, "sm.pos <= b"))
def walk_forward_folds(spark, sf_dir):
    """Expanding folds of monthly samples, purged."""
    return validation.fold_table(validation.walk_forward_folds(_samples(spark, sf_dir), 36, 12))


@query(
    "WITH "
    + ",".join([q.BARS, MONTH_ENDS, _MONTHS])
    + ","
    + _roles_sql(f"nt AS (SELECT *, ntile(5) OVER (PARTITION BY series_id ORDER BY t0) - 1 AS fold FROM sm), sp AS (SELECT series_id, fold::INT AS fold, {_SPAN} FROM nt GROUP BY 1, 2)", 3, "true")
)
def purged_kfold(spark, sf_dir):
    """Five contiguous blocks, purged and with an embargo of three samples."""
    return validation.fold_table(validation.purged_kfold(_samples(spark, sf_dir), 5, 3))


@query(
    q.with_(
        q.BARS,
        select="""SELECT series_id, 'daily_features' AS transform, count(*) AS rows, 0::BIGINT AS changed FROM bars WHERE date <= DATE '1998-06-30' GROUP BY series_id
        UNION ALL SELECT series_id, 'rsi_signal', count(*), 0 FROM bars WHERE date <= DATE '1998-06-30' GROUP BY series_id""",
    )
)
def lookahead_check(spark, sf_dir):
    """Earlier outputs that change when later prices are rewritten: none."""
    bars = panels.bars6(spark, sf_dir)
    checks = {"daily_features": indicators.daily_features, "rsi_signal": signals.mean_reversion_rsi}
    out = None
    for name, transform in checks.items():
        own = validation.lookahead_check(transform, bars, "1998-06-30").withColumn("transform", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


_ER = f"abs(close - lag(close, 60) OVER ({q.S})) / nullif({q.full('sum', 'ad', 60)}, 0)"


@query(
    q.with_(
        *STACKED_CTES,
        f"er AS (SELECT series_id, date, round({_ER}, 9) AS er FROM (SELECT *, abs(delta) AS ad FROM rets)), ter AS (SELECT *, ntile(3) OVER (PARTITION BY series_id ORDER BY er, date) AS tercile FROM er WHERE er IS NOT NULL)",
        select="""SELECT run_id, series_id, tercile, count(*) AS days, round(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 6) + 0.0::DOUBLE AS sharpe
        FROM (SELECT *, coalesce(strategy_return, 0.0) AS ret FROM bt) JOIN ter USING (series_id, date) GROUP BY run_id, series_id, tercile""",
    )
)
def chop_vs_trend_sharpe(spark, sf_dir):
    """Sharpe of each run by terciles of the efficiency ratio, from choppy to trending days."""
    from pyspark.sql import Window

    from panelquant.functions.columns import sharpe

    bars, _, rows = stacked_runs(spark, sf_dir)
    er = indicators.regime_features(bars.select("series_id", "date", "close")).select("series_id", "date", F.round("efficiency_ratio", 9).alias("er"))
    er = er.where("er is not null").withColumn("tercile", F.ntile(3).over(Window.partitionBy("series_id").orderBy("er", "date")))
    rows = rows.join(er, ["series_id", "date"]).withColumn("ret", F.coalesce("strategy_return", F.lit(0.0)))
    return rows.groupBy("run_id", "series_id", "tercile").agg(F.count("*").alias("days"), r6(sharpe(F.col("ret"))).alias("sharpe"))


_M = {"ret_1m": 21, "ret_3m": 63, "ret_6m": 126, "ret_12m": 252}
MONTHLY = f"""
mf AS (SELECT series_id, date, close, {", ".join(f"close / lag(close, {n}) OVER ({q.S}) - 1 AS {c}" for c, n in _M.items())},
  lag(close, 21) OVER ({q.S}) / lag(close, 252) OVER ({q.S}) - 1 AS mom_12_1, close / ({q.full("avg", "close", 200)}) - 1 AS sma200_gap,
  {q.full("stddev_samp", "r", 20)} * sqrt(252) AS vol_20, {q.full("stddev_samp", "r", 60)} * sqrt(252) AS vol_60, close / ({q.full("max", "close", 252)}) - 1 AS drawdown FROM rets),
mm AS (SELECT mf.* FROM mf JOIN ends USING (series_id, date)),
mn AS (SELECT *, date AS t0, lead(date) OVER ({q.S}) AS t1, lead(close) OVER ({q.S}) / close - 1 AS forward_return FROM mm),
my AS (SELECT *, CASE WHEN forward_return IS NOT NULL THEN (forward_return > 0)::INT END AS y FROM mn),
monthly AS (SELECT * FROM (SELECT *, lag(y) OVER ({q.S}) AS previous FROM my) WHERE y IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in learning.BASE_FEATURES)})"""


@query(
    q.with_(
        q.BARS, q.RETURNS, MONTH_ENDS, MONTHLY,
        select=f"SELECT series_id, t0, t1, y, previous, {q.r6('forward_return')} AS forward_return, " + ", ".join(f"{q.r6(c)} AS {c}" for c in learning.BASE_FEATURES) + " FROM monthly",
    )
)
def monthly_dataset(spark, sf_dir):
    """Monthly samples with features, label, previous label and forward return."""
    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir))
    return rows.withColumns({c: r6(c) for c in ("forward_return", *learning.BASE_FEATURES)})


@query(
    q.with_(
        q.BARS,
        select="""SELECT series_id, kind, count(*) AS rows, 0::BIGINT AS changed FROM bars, (SELECT unnest(['boosted', 'logistic']) AS kind) WHERE date <= DATE '2000-12-29' GROUP BY series_id, kind""",
    )
)
def ml_signal_lookahead(spark, sf_dir):
    """Earlier positions of learning strategies that change when prices after their cutoff are rewritten: none."""
    bars = panels.bars6(spark, sf_dir)
    out = None
    for kind in ml_signals.KINDS:
        own = validation.lookahead_check(lambda b, kind=kind: ml_signals.ml_direction(b, kind=kind), bars, "2000-12-29").withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def ml_signal_reports(spark, sf_dir):
    """Learning strategies as a whole, with the regime as a feature or a model each, and learned anew in each fold; reports of the days out of sample."""
    bars = panels.bars6(spark, sf_dir)
    labels = labels5(spark, sf_dir)
    runs = None
    for name, options in {"plain": {}, "feature": {"labels": labels}, "conditional": {"labels": labels, "mode": "conditional"}}.items():
        own = ml_signals.ml_direction(bars, **options).withColumn("run_id", F.lit(name))
        runs = own if runs is None else runs.unionByName(own)
    tested = validation.halves(backtest.run_backtest(bars, runs)).where("half = 'out_of_sample'")
    whole = reports.full_report(tested, ["run_id", "series_id"])
    anew = validation.refit_signals(bars, lambda b: ml_signals.ml_direction(b, ml_signals.refit_share(756, 126)))
    own = anew.withColumn("source", F.col("series_id")).withColumn("series_id", F.concat_ws("#", "series_id", "fold"))
    folds = backtest.run_backtest(own.select("series_id", "date", "close"), own.select("series_id", "date", "signal"))
    folds = folds.join(own.select("series_id", "date", "is_test", "source"), ["series_id", "date"]).where("is_test")
    refit = reports.full_report(folds.withColumns({"series_id": F.col("source"), "run_id": F.lit("refit")}), ["run_id", "series_id"])
    return _reported(whole.unionByName(refit))

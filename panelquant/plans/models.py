"""Baselines, scores and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import ordered, r6
from panelquant.operators import backtest, indicators, learning, regimes, resampling, validation
from panelquant.sources import panels

from . import sql as q
from .labels import features
from .registry import query
from .runs import DAILY_COLUMNS, DAILY_CTES, MONTH_ENDS
from .studies import MONTHLY

_HEAD = (q.BARS, q.RETURNS, MONTH_ENDS, MONTHLY)
_FOLDS = f"""
mp AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t0) - 1 AS pos FROM monthly),
sp AS (SELECT x.series_id, min(x.pos) AS start FROM mp x WHERE x.pos >= 24 AND (SELECT count(*) FROM mp y WHERE y.series_id = x.series_id AND y.t1 < x.t0) >= 24 GROUP BY 1),
ms AS (SELECT series_id, floor((pos - start) / 12)::INT AS fold, min(pos) AS a, max(pos) AS b, min(t0) AS s, max(t1) AS e FROM mp JOIN sp USING (series_id) WHERE pos >= start GROUP BY 1, 2),
mr AS (SELECT mp.*, ms.fold, CASE WHEN mp.pos BETWEEN a AND b THEN 'test' WHEN mp.t0 <= e AND mp.t1 >= s THEN 'purged' ELSE 'train' END AS role FROM mp JOIN ms USING (series_id) WHERE mp.pos <= b)"""


def _monthly(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    # few rows, but each use of them would read the transactions anew
    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir).cache()).cache()
    roles = validation.walk_forward_folds(rows.select("series_id", "t0", "t1"), 24, 12)
    return rows, rows.join(roles.select("series_id", "t0", "fold", "role"), ["series_id", "t0"])


@query(
    q.with_(
        *_HEAD,
        _FOLDS,
        """tn AS (SELECT series_id, fold, y, count(*) AS n FROM mr WHERE role = 'train' GROUP BY ALL),
        mj AS (SELECT series_id, fold, y AS major FROM tn QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY n DESC, y) = 1)""",
        select="""SELECT series_id, fold, count(*) AS months, round(avg((y = major)::INT), 6) AS majority, round(avg((y = coalesce(previous, 0))::INT), 6) AS previous,
        round(avg((y = 1)::INT), 6) AS hold, round(greatest(avg(y), 1 - avg(y)), 6) AS base_rate FROM mr JOIN mj USING (series_id, fold) WHERE role = 'test' GROUP BY series_id, fold""",
    )
)
def baseline_accuracy(spark, sf_dir):
    """Accuracy of the majority class, the previous label and buy-and-hold, by fold."""
    _, rows = _monthly(spark, sf_dir)
    major = rows.where("role = 'train'").groupBy("series_id", "fold").agg(learning.majority().alias("major"))
    rows = rows.where("role = 'test'").join(major, ["series_id", "fold"])
    hit = lambda c: F.round(F.avg((F.col("y") == c).cast("double")), 6)
    share = F.avg(F.col("y").cast("double"))
    return rows.groupBy("series_id", "fold").agg(
        F.count("*").alias("months"), hit(F.col("major")).alias("majority"), hit(F.coalesce("previous", F.lit(0))).alias("previous"),
        hit(F.lit(1)).alias("hold"), F.round(F.greatest(share, 1 - share), 6).alias("base_rate"),
    )


def _floored(a: str, b: str) -> str:
    return f"greatest({a}, 0.0001) / (greatest({a}, 0.0001) + greatest({b}, 0.0001))"


_CONDITIONAL = f"""
cs AS (SELECT series_id, fold, previous, avg(1 - y) AS a, avg(y) AS b FROM mr WHERE role = 'train' AND previous IS NOT NULL GROUP BY ALL),
ps AS (SELECT series_id, fold, avg(1 - y) AS a, avg(y) AS b FROM mr WHERE role = 'train' GROUP BY ALL),
cp AS (SELECT t.series_id, t.fold, t.t0, t.y, coalesce({_floored("cs.b", "cs.a")}, {_floored("ps.b", "ps.a")}) AS p FROM mr t
  LEFT JOIN cs ON cs.series_id = t.series_id AND cs.fold = t.fold AND cs.previous = t.previous JOIN ps ON ps.series_id = t.series_id AND ps.fold = t.fold WHERE t.role = 'test')"""


def _conditional(spark, sf_dir) -> DataFrame:
    """Test rows with class shares given the previous label."""
    _, rows = _monthly(spark, sf_dir)
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    return learning.conditional_probabilities(train, test, "previous", [0, 1], ["series_id", "fold"])


_NULL_SAFE = _CONDITIONAL.replace("cs.b", "x.b").replace("cs.a", "x.a").replace("LEFT JOIN cs ON cs.series_id", "LEFT JOIN cs x ON x.series_id").replace("cs.fold = t.fold AND cs.previous", "x.fold = t.fold AND x.previous")


def _cond_sql(select: str) -> str:
    guarded = _NULL_SAFE.replace(f"coalesce({_floored('x.b', 'x.a')}, ", f"coalesce(CASE WHEN x.b IS NOT NULL THEN {_floored('x.b', 'x.a')} END, ")
    return q.with_(*_HEAD, _FOLDS, guarded, select=select)


@query(_cond_sql("SELECT series_id, fold, t0, y, round(p, 6) AS p_up FROM cp"))
def conditional_prior(spark, sf_dir):
    """Probability of a rise given the previous month, with a fallback to the plain share."""
    return _conditional(spark, sf_dir).select("series_id", "fold", "t0", "y", F.round(F.col("proba")[1], 6).alias("p_up"))


@query(
    _cond_sql(
        """SELECT series_id, count(*) AS months, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss, round(avg((p - y) ** 2 + (1 - p - (1 - y)) ** 2), 6) AS brier FROM cp GROUP BY series_id"""
    )
)
def log_loss_brier(spark, sf_dir):
    """Log loss and Brier score of those probabilities."""
    rows = _conditional(spark, sf_dir)
    place = F.col("y") + 1
    return rows.groupBy("series_id").agg(
        F.count("*").alias("months"), F.round(F.avg(learning.log_loss("proba", place)), 6).alias("log_loss"), F.round(F.avg(learning.brier("proba", place)), 6).alias("brier")
    )


@query(
    _cond_sql(
        """SELECT series_id, round(avg(recall), 6) AS balanced_accuracy FROM (SELECT series_id, y, avg((y = (p > 0.5)::INT)::INT) AS recall FROM cp GROUP BY series_id, y) GROUP BY series_id"""
    )
)
def balanced_accuracy(spark, sf_dir):
    """Mean recall of the classes."""
    rows = _conditional(spark, sf_dir).withColumn("predicted", (F.col("proba")[1] > 0.5).cast("int"))
    return learning.balanced_accuracy(rows, ["series_id"]).withColumn("balanced_accuracy", F.round("balanced_accuracy", 6))


_SCORED = "sc AS (SELECT d.series_id, d.date, round(return_5d, 9) AS score, (nx > d.close)::INT AS y FROM daily d JOIN (SELECT series_id, date, lead(close) OVER (PARTITION BY series_id ORDER BY date) AS nx FROM bars) USING (series_id, date) WHERE return_5d IS NOT NULL AND nx IS NOT NULL)"


def _scored(spark, sf_dir) -> DataFrame:
    bars = panels.bars6(spark, sf_dir)
    rows = indicators.daily_features(bars).select("series_id", "date", F.round("return_5d", 9).alias("score"))
    return rows.join(indicators.next_day_label(bars), ["series_id", "date"]).dropna().withColumn("y", F.col("y").cast("int"))


@query(
    q.with_(
        *DAILY_CTES,
        _SCORED,
        "rk AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY score) + (count(*) OVER (PARTITION BY series_id, score) - 1) / 2 AS rk FROM sc)",
        select="""SELECT series_id, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives,
        round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM rk GROUP BY series_id""",
    )
)
def auc_table(spark, sf_dir):
    """Area under the curve of the five-day return for the next day's direction."""
    return learning.auc(_scored(spark, sf_dir), ["series_id"]).withColumn("auc", F.round("auc", 6))


@query(
    q.with_(
        *DAILY_CTES,
        _SCORED,
        select="""SELECT series_id, bin, round(avg(score), 6) + 0.0::DOUBLE AS mean_score, round(avg(y), 6) AS share, count(*) AS rows
        FROM (SELECT *, ntile(10) OVER (PARTITION BY series_id ORDER BY score, date) AS bin FROM sc) GROUP BY series_id, bin""",
    )
)
def calibration_bins(spark, sf_dir):
    """Ten bins of equal count by score."""
    rows = learning.calibration_bins(_scored(spark, sf_dir), ["series_id"], "score", "y", 10, "date")
    return rows.withColumns({"mean_score": r6("mean_score"), "share": F.round("share", 6)})


@query(
    q.with_(
        *DAILY_CTES,
        _SCORED,
        "pr AS (SELECT *, (score > 0)::INT AS a, (coalesce(lag(y) OVER (PARTITION BY series_id ORDER BY date), 0))::INT AS b FROM sc)",
        "mc AS (SELECT series_id, count(*) AS n, count(*) FILTER (a = y) AS hits, count(*) FILTER (a = y AND b <> y) AS only_a, count(*) FILTER (a <> y AND b = y) AS only_b FROM pr GROUP BY series_id)",
        select="""SELECT series_id, n, hits, round((hits / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) - 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 3.8414588206941254 / (4 * n * n)) / (1 + 3.8414588206941254 / n), 6) AS low,
        round((hits / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) + 1.959963984540054 * sqrt(hits / n * (1 - hits / n) / n + 3.8414588206941254 / (4 * n * n)) / (1 + 3.8414588206941254 / n), 6) AS high, only_a, only_b FROM mc""",
    )
)
def wilson_mcnemar(spark, sf_dir):
    """Wilson interval of a rule's accuracy, and its discordant cells against another rule."""
    w = ordered()
    rows = _scored(spark, sf_dir).withColumns({"a": (F.col("score") > 0).cast("int"), "b": F.coalesce(F.lag("y").over(w), F.lit(0))})
    a, b = F.col("a") == F.col("y"), F.col("b") == F.col("y")
    rows = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(a).alias("hits"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    low, high = resampling.wilson(F.col("hits"), F.col("n"))
    return rows.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


@query()
def mcnemar_p_value(spark, sf_dir):
    """Exact two-sided p-value of the discordant cells; SQL has no binomial tail."""
    rows = wilson_mcnemar(spark, sf_dir)
    p = resampling.two_sided_binomial(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b"))
    return rows.select("series_id", F.round(p, 9).alias("p_value"))


@query(
    q.with_(
        *_HEAD,
        f"sg AS (SELECT *, CASE WHEN mom_12_1 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS position FROM monthly)",
        "sr AS (SELECT *, position * forward_return - coalesce(abs(position - lag(position) OVER (PARTITION BY series_id ORDER BY t0)), abs(position)) * 5.0 / 10000 AS s FROM sg)",
        select="""SELECT series_id, count(*) AS months, round(avg(position), 6) AS exposure, round(avg(s), 6) + 0.0::DOUBLE AS mean_return,
        round(CASE WHEN stddev_samp(s) > 1e-12 THEN avg(s) / stddev_samp(s) * sqrt(12) ELSE 0 END, 6) + 0.0::DOUBLE AS sharpe FROM sr GROUP BY series_id""",
    )
)
def monthly_trading_summary(spark, sf_dir):
    """Holding after a positive 12-1 momentum, month by month, with entry costs."""
    from panelquant.functions.columns import sharpe

    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir)).withColumn("position", (F.col("mom_12_1") > 0).cast("double"))
    rows = backtest.strategy_returns(rows)
    return rows.groupBy("series_id").agg(
        F.count("*").alias("months"), F.round(F.avg("position"), 6).alias("exposure"), r6(F.avg("strategy_return")).alias("mean_return"), r6(sharpe(F.col("strategy_return"), 12)).alias("sharpe")
    )


# Fitted models: no SQL; tests hold their invariants -----------------------------------------------------------

_FIT = ("vol_20d", "trend_60d", "drawdown_252d", "efficiency_ratio")


def _fit_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = features(spark, sf_dir).cache()
    return rows, regimes.fit_rows(regimes.complete_rows(rows, _FIT)).cache()


def _days(labels: DataFrame, rows: DataFrame, keys=("series_id",)) -> DataFrame:
    """Days and mean volatility by label, renumbered from calm to wild."""
    own, names = regimes.order_and_name(labels.select("series_id", "date", "label"), rows)
    counts = own.groupBy(*keys, "label").agg(F.count("*").alias("days"))
    return counts.join(names, [*keys, "label"]).select(*keys, "label", "name", "days", r6("vol").alias("vol"))


@query()
def kmeans_regimes(spark, sf_dir):
    """Three clusters, pooled over the series."""
    rows, fit = _fit_rows(spark, sf_dir)
    return _days(regimes.kmeans_labels(fit, _FIT), rows)


@query()
def gmm_regimes(spark, sf_dir):
    """A Gaussian mixture on the first two principal components."""
    rows, fit = _fit_rows(spark, sf_dir)
    return _days(regimes.mixture_labels(regimes.reduced(fit, _FIT, 2), ("pc_1", "pc_2")), rows)


@query()
def hmm_regimes(spark, sf_dir):
    """A hidden Markov model a series, filtered."""
    rows, fit = _fit_rows(spark, sf_dir)
    fit = fit.withColumn("model_id", F.col("series_id"))
    models = regimes.fit_hmm(fit, _FIT)
    return _days(regimes.hmm_labels(fit, _FIT, models), rows)


@query()
def hmm_walk_forward(spark, sf_dir):
    """Refits on growing windows, all at once, each labelling the rows up to the next."""
    _, fit = _fit_rows(spark, sf_dir)
    plan = regimes.refit_schedule(fit.drop("fit"))
    models = regimes.fit_hmm(plan, _FIT)
    labels = regimes.hmm_labels(plan.where("fit or test"), _FIT, models)
    tested = plan.where("test").select("model_id", "series_id", "date", "refit")
    rows = labels.join(tested, ["model_id", "series_id", "date"])
    return rows.groupBy("series_id", "refit", "label").agg(F.count("*").alias("days"))


@query()
def supervised_regimes(spark, sf_dir):
    """Regimes of the next twenty days, learned from today's features."""
    rows, fit = _fit_rows(spark, sf_dir)
    return _days(regimes.supervised_labels(panels.bars6(spark, sf_dir), fit, _FIT), rows)


@query()
def ml_direction(spark, sf_dir):
    """Logistic and forest models of the next day's direction: accuracy in the test part."""
    table = learning.daily_table(panels.bars6(spark, sf_dir)).cache()
    out = None
    for kind in ("logistic", "forest"):
        rows = learning.predicted(learning.train_direction(table, DAILY_COLUMNS, kind), table.where("role = 'test'"))
        own = learning.auc(rows, ["series_id"]).join(rows.groupBy("series_id").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy")), "series_id")
        own = own.withColumn("model", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def ml_direction_by_regime(spark, sf_dir):
    """A model for each volatility regime with enough rows."""
    bars = panels.bars6(spark, sf_dir)
    labels = regimes.rules_labels(features(spark, sf_dir))
    table = learning.daily_table(bars).join(labels, ["series_id", "date"]).cache()
    models = learning.train_by_regime(table, DAILY_COLUMNS)
    rows = learning.predicted_by_regime(models, table.where("role = 'test'"))
    return rows.groupBy("series_id", "label").agg(F.count("*").alias("days"), F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"))


@query()
def nested_walk_forward(spark, sf_dir):
    """Monthly direction with the regularisation chosen inside each training window."""
    rows, _ = _monthly(spark, sf_dir)
    pooled = rows.select("series_id", "t0", "t1", "y", *learning.BASE_FEATURES)
    roles = validation.walk_forward_folds(pooled.select("series_id", "t0", "t1"), 24, 12)
    return learning.nested_walk_forward(pooled, roles, learning.BASE_FEATURES, (0.001, 0.01, 0.1, 1.0, 10.0))

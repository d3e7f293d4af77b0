"""Tuned models, their registry, and predictions from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.functions.columns import r6
from panelquant.operators import adaptive, learning, regimes, resampling, tuning, validation
from panelquant.sources import features as stored_features
from panelquant.sources import folders, models, panels

from . import sql as q
from .labels import features
from .registry import query
from .runs import MONTH_ENDS
from .studies import MONTHLY

_HEAD = (q.BARS, q.RETURNS, MONTH_ENDS, MONTHLY)
COLUMNS = learning.BASE_FEATURES
#: Months before the first test, months a test, months of embargo. Fixed values.
MIN_TRAIN, TEST, EMBARGO = 60, 24, 1
GRID = [*tuning.LOGISTIC_GRID, *tuning.BOOSTED_GRID]

_OUTER = f"""
mp AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t0) - 1 AS pos FROM monthly),
sp AS (SELECT x.series_id, min(x.pos) AS start FROM mp x WHERE x.pos >= {MIN_TRAIN} AND (SELECT count(*) FROM mp y WHERE y.series_id = x.series_id AND y.t1 < x.t0) >= {MIN_TRAIN} GROUP BY 1),
ms AS (SELECT series_id, floor((pos - start) / {TEST})::INT AS fold, min(pos) AS a, max(pos) AS b, min(t0) AS s, max(t1) AS e FROM mp JOIN sp USING (series_id) WHERE pos >= start GROUP BY 1, 2),
mr AS (SELECT mp.*, ms.fold, CASE WHEN mp.pos BETWEEN a AND b THEN 'test' WHEN mp.t0 <= e AND mp.t1 >= s THEN 'purged' WHEN mp.pos BETWEEN b + 1 AND b + {EMBARGO} THEN 'embargoed' ELSE 'train' END AS role FROM mp JOIN ms USING (series_id) WHERE mp.pos <= b)"""
_INNER = f"""
it AS (SELECT series_id, fold, t0, t1, y, row_number() OVER (PARTITION BY series_id, fold ORDER BY t0) - 1 AS pos, ntile(5) OVER (PARTITION BY series_id, fold ORDER BY t0) - 1 AS own FROM mr WHERE role = 'train'),
isp AS (SELECT series_id, fold, own AS inner_fold, min(pos) AS a, max(pos) AS b, min(t0) AS s, max(t1) AS e FROM it GROUP BY ALL),
ir AS (SELECT it.series_id, it.fold, isp.inner_fold, it.t0, it.t1, s, e, it.y, CASE WHEN pos BETWEEN a AND b THEN 'test' WHEN t0 <= e AND t1 >= s THEN 'purged' WHEN pos BETWEEN b + 1 AND b + {EMBARGO} THEN 'embargoed' ELSE 'train' END AS role
  FROM it JOIN isp ON isp.series_id = it.series_id AND isp.fold = it.fold)"""


def _samples(spark, sf_dir) -> DataFrame:
    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir))
    return rows.select("series_id", "t0", "t1", F.col("y").cast("int").alias("y"), F.array(*COLUMNS).alias("x"))


def _outer(samples: DataFrame) -> DataFrame:
    return validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), MIN_TRAIN, TEST, EMBARGO)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder: what is fitted is fitted once."""
    path = folders.passing(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(
    q.with_(
        *_HEAD, _OUTER, _INNER,
        select="""SELECT series_id, fold, inner_fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'purged') AS n_purged,
        count(*) FILTER (role = 'embargoed') AS n_embargoed, count(*) FILTER (role = 'train' AND t0 <= e AND t1 >= s) AS n_meeting FROM ir GROUP BY ALL""",
    )
)
def inner_fold_roles(spark, sf_dir):
    """Roles in the inner folds of each outer training set, and how many training labels meet the test span (none may)."""
    inner = tuning.inner_roles(_outer(_samples(spark, sf_dir)))
    spans = inner.where("role = 'test'").groupBy("series_id", "fold", "inner").agg(F.min("t0").alias("s"), F.max("t1").alias("e"))
    rows = inner.join(spans, ["series_id", "fold", "inner"])
    count = lambda c, name: F.count_if(c).alias(name)
    roles = [count(F.col("role") == r, f"n_{r}") for r in ("train", "test", "purged", "embargoed")]
    meeting = (F.col("role") == "train") & (F.col("t0") <= F.col("e")) & (F.col("t1") >= F.col("s"))
    return rows.groupBy("series_id", "fold", F.col("inner").alias("inner_fold")).agg(*roles, count(meeting, "n_meeting"))


def _named(predictions: DataFrame, grid=GRID) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in grid]), F.col("setting") + 1)
    return predictions.select("series_id", "fold", "t0", "y", kind.alias("kind"), "setting", F.transform("proba", lambda p: F.round(p, 9)).alias("proba"))


@query()
def tuned_walk_forward(spark, sf_dir):
    """Monthly direction by 5 logistic and 18 boosted settings, tuned inside each outer training set."""
    samples = _kept(_samples(spark, sf_dir), "samples")
    return _named(tuning.nested_walk_forward(samples, _outer(samples), GRID, 2)[0])


def _regime_samples(spark, sf_dir) -> DataFrame:
    labels = _kept(regimes.rules_labels(features(spark, sf_dir)), "labels")
    return _kept(learning.regime_dataset(panels.bars6(spark, sf_dir), labels), "samples")


@query()
def tuned_regime_walk_forward(spark, sf_dir):
    """The next month's regime of four, with the regime of the decision date as codes."""
    rows = _regime_samples(spark, sf_dir)
    samples = rows.select("series_id", "t0", "t1", F.col("y").cast("int").alias("y"), F.array(*COLUMNS, "regime_rules").alias("x"))
    codes = {len(COLUMNS): [0.0, 1.0, 2.0, 3.0]}
    return _named(tuning.nested_walk_forward(samples, _outer(samples), GRID, 4, codes)[0])


_REGIME_MONTHLY = f"""
mk AS (SELECT l.series_id, l.date, l.label, (SELECT max(e.date) FROM ends e WHERE e.series_id = l.series_id AND e.date < l.date) AS t0 FROM rules l),
md AS (SELECT series_id, t0, label AS y FROM (SELECT series_id, t0, label, count(*) AS n, max(date) AS latest FROM mk WHERE t0 IS NOT NULL AND label <> -1 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY series_id, t0 ORDER BY n DESC, latest DESC) = 1),
ra AS (SELECT mn.series_id, mn.t0, mn.t1, CASE WHEN l.label >= 0 THEN l.label END AS regime_rules, md.y, {", ".join(COLUMNS)} FROM mn
  LEFT JOIN rules l ON l.series_id = mn.series_id AND l.date = mn.t0 LEFT JOIN md ON md.series_id = mn.series_id AND md.t0 = mn.t0 WHERE mn.t1 IS NOT NULL),
rm AS (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t0) AS previous FROM ra)
  WHERE y IS NOT NULL AND previous IS NOT NULL AND regime_rules IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)})"""


@query(
    q.with_(
        q.LABELS, MONTH_ENDS, MONTHLY, _REGIME_MONTHLY, _OUTER.replace("FROM monthly", "FROM rm"),
        """mj AS (SELECT series_id, fold, y AS major FROM (SELECT series_id, fold, y, count(*) AS n FROM mr WHERE role = 'train' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series_id, fold ORDER BY n DESC, y) = 1)""",
        """lk AS (SELECT series_id, fold, regime_rules, y AS looked FROM (SELECT series_id, fold, regime_rules, y, count(*) AS n FROM mr WHERE role = 'train' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series_id, fold, regime_rules ORDER BY n DESC, y) = 1)""",
        select="""SELECT mr.series_id, mr.fold, count(*) AS months, round(avg((y = major)::INT), 6) AS majority, round(avg((y = previous)::INT), 6) AS previous,
        round(avg((y = mr.regime_rules)::INT), 6) AS rules_at_decision, round(avg((y = coalesce(looked, major))::INT), 6) AS rules_lookup
        FROM mr JOIN mj ON mj.series_id = mr.series_id AND mj.fold = mr.fold LEFT JOIN lk ON lk.series_id = mr.series_id AND lk.fold = mr.fold AND lk.regime_rules = mr.regime_rules
        WHERE role = 'test' GROUP BY mr.series_id, mr.fold""",
    )
)
def regime_lookup_accuracy(spark, sf_dir):
    """Accuracy of simple forecasts of the next month's regime: majority, previous, the rules' regime, and what followed it in training."""
    rows = _regime_samples(spark, sf_dir)
    rows = rows.join(_outer(rows).select("series_id", "t0", "fold", "role"), ["series_id", "t0"])
    train, key = rows.where("role = 'train'"), ["series_id", "fold"]
    major = train.groupBy(*key).agg(learning.majority().alias("major"))
    looked = train.groupBy(*key, "regime_rules").agg(learning.majority().alias("looked"))
    rows = rows.where("role = 'test'").join(major, key).join(looked, [*key, "regime_rules"], "left")
    hit = lambda c, name: F.round(F.avg((F.col("y") == c).cast("double")), 6).alias(name)
    return rows.groupBy(*key).agg(
        F.count("*").alias("months"), hit(F.col("major"), "majority"), hit(F.col("previous"), "previous"),
        hit(F.col("regime_rules"), "rules_at_decision"), hit(F.coalesce("looked", "major"), "rules_lookup"),
    )


@query(
    q.with_(
        *_HEAD, _OUTER, _INNER,
        select=f"SELECT series_id, fold, {len(GRID)}::BIGINT AS settings, 1::BIGINT AS selected, count(*) FILTER (role = 'test' AND EXISTS (SELECT 1 FROM ir i2 WHERE i2.series_id = ir.series_id AND i2.fold = ir.fold AND i2.inner_fold = ir.inner_fold AND i2.role = 'train')) AS months FROM ir GROUP BY series_id, fold",
    )
)
def trial_log(spark, sf_dir):
    """Tuning trials written as lines of JSON and read again: settings, chosen ones and months that each was scored on."""
    samples = _kept(_samples(spark, sf_dir), "samples")
    tried = tuning.trials(tuning.inner_predictions(samples, tuning.inner_roles(_outer(samples)), GRID, 2))
    path = folders.passing(spark, "trials")
    models.write_trials(tried, path)
    back = models.read_trials(spark, path, tried.schema.simpleString()[7:-1].replace(":", " "))
    return back.groupBy("series_id", "fold").agg(F.count("*").alias("settings"), F.count_if("selected").alias("selected"), F.max("inner_n").alias("months"))


def _registered(spark, sf_dir) -> tuple[str, DataFrame]:
    """(the registry's folder, what registering the same models a second time gives)."""
    bars = panels.bars6(spark, sf_dir)
    samples = _kept(_samples(spark, sf_dir), "samples")
    inputs = models.serving_inputs(learning.monthly_features(bars), COLUMNS)
    fitted = tuning.tuned_models(samples, tuning.BOOSTED_GRID, 2, COLUMNS).join(inputs, "series_id")
    trained = _kept(
        fitted.withColumns(
            {
                "name": F.concat(F.lit("direction-"), "series_id"), "snapshot_id": F.col("series_id"), "target": F.lit("direction"),
                "feature_set": F.lit("base"), "classes": F.lit(2), "metrics": F.to_json(F.create_map(F.lit("n_train"), F.col("n_train"))),
            }
        ),
        "trained",
    )
    path = folders.passing(spark, "registry")
    models.register(spark, path, trained)
    return path, models.register(spark, path, trained)


_SERVED = f"""
sv AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1),
sx AS (SELECT series_id, date AS as_of, sha256(concat_ws('|', 'panelquant-features/1', strftime(date, '%Y-%m-%d'), {", ".join(f"'{c}=' || CAST(CAST(round(round({c}, 9) * 1e9) AS BIGINT) AS VARCHAR)" for c in COLUMNS)})) AS features_sha256 FROM sv)"""


@query(
    q.with_(
        *_HEAD, _SERVED,
        select="""SELECT 'direction-' || series_id AS name, 1 AS version, false AS created, count(*) AS n_train, min(t0) AS train_first, max(t0) AS train_last, max(t1) AS label_end,
        any_value(as_of) AS serving_as_of, any_value(features_sha256) AS features_sha256 FROM monthly JOIN sx USING (series_id) GROUP BY series_id""",
    )
)
def serving_registry(spark, sf_dir):
    """Direction models tuned by 18 boosted settings, registered twice: one version each."""
    _, rows = _registered(spark, sf_dir)
    return models.summaries(models.verified(rows)).select("name", "version", "created", "n_train", "train_first", "train_last", "label_end", "serving_as_of", "features_sha256")


@query(
    q.with_(
        *_HEAD, _SERVED,
        select="SELECT 'direction-' || series_id AS name, series_id, 1 AS version, as_of, features_sha256, 1::BIGINT AS logged, 1.0::DOUBLE AS total FROM sx",
    )
)
def prediction_log(spark, sf_dir):
    """The newest versions scored twice on their stored inputs: one log row each."""
    path, _ = _registered(spark, sf_dir)
    newest = models.latest(folders.table(spark, path, models.REGISTRY))
    log = folders.passing(spark, "predictions")
    models.predict(spark, newest, log)
    rows = models.predict(spark, newest, log)
    total = F.round(F.sum(F.aggregate("proba", F.lit(0.0), lambda a, p: a + p)), 9)
    return rows.groupBy("name", "series_id", "version", "as_of", "features_sha256").agg(F.count("*").alias("logged"), total.alias("total"))


#: Regime features of the stored states: volatility, trend, drawdown and path. A narrower set than all 15, to keep the query short.
STATE_FEATURES = ("vol_20d", "trend_60d", "drawdown_252d", "efficiency_ratio")


def _states(spark, sf_dir) -> DataFrame:
    return stored_features.hmm_features(spark, folders.passing(spark, "states"), panels.bars6(spark, sf_dir), STATE_FEATURES)


@query(
    q.with_(
        q.LABELS,
        f"""hr AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM scaled WHERE {" AND ".join(f"{c} IS NOT NULL" for c in STATE_FEATURES)}),
        hc AS (SELECT series_id, min(date) AS causal_from, count(*) AS labelled FROM hr WHERE pos >= 504 GROUP BY series_id),
        ln AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, lead(date) OVER (PARTITION BY series_id ORDER BY date) AS after FROM bars),
        le AS (SELECT series_id, date AS learn_end, after FROM ln WHERE pos = greatest(floor(n * 0.25) - 1, 0))""",
        select="SELECT series_id, causal_from, labelled, learn_end, greatest(causal_from, after) AS oos_from FROM hc JOIN le USING (series_id)",
    )
)
def hmm_causality(spark, sf_dir):
    """Stored walk-forward states: first causal day, labelled days, and the first day out of sample of a strategy that learns on the first quarter."""
    rows = _states(spark, sf_dir)
    causal = rows.groupBy("series_id").agg(F.min("causal_from").alias("causal_from"), F.count("*").alias("labelled"))
    oos = stored_features.out_of_sample_from(adaptive.learn_ends(panels.bars6(spark, sf_dir), 0.25), causal)
    return causal.join(oos, "series_id").select("series_id", "causal_from", "labelled", "learn_end", "oos_from")


@query()
def hmm_feature_value(spark, sf_dir):
    """Monthly direction with and without the stored states, on the months that both test: accuracy, log loss, paired interval, exact test and verdict."""
    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir))
    rows = _kept(stored_features.attached(rows, _states(spark, sf_dir)), "samples")
    rows = rows.dropna(subset=["regime_hmm"])  # the months that both sets have
    tested = None
    for name, columns in {"base": COLUMNS, "hmm": (*COLUMNS, "regime_hmm", "hmm_p0", "hmm_p1", "hmm_p2")}.items():
        samples = rows.select("series_id", "t0", "t1", F.col("y").cast("int").alias("y"), F.array(*columns).alias("x"))
        codes = {columns.index("regime_hmm"): [0.0, 1.0, 2.0]} if name == "hmm" else {}
        outer = validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), 24, 12, EMBARGO)
        found = tuning.nested_walk_forward(samples, outer, tuning.LOGISTIC_GRID, 2, codes)[0]
        right = (F.array_position("proba", F.array_max("proba")) - 1 == F.col("y")).cast("double")
        found = found.select("series_id", "t0", right.alias(name), learning.log_loss("proba", F.col("y") + 1).alias(f"loss_{name}"))
        tested = found if tested is None else tested.join(found, ["series_id", "t0"])
    tested = _kept(tested, "tested")
    losses = tested.groupBy("series_id").agg(r6(F.avg("loss_base")).alias("loss_base"), r6(F.avg("loss_hmm")).alias("loss_hmm"))
    out = resampling.verdicts(tested, ["series_id"], "hmm", "base").join(losses, "series_id")
    return out.select(
        "series_id", "months", r6("mean_a").alias("accuracy_hmm"), r6("mean_b").alias("accuracy_base"), r6("difference").alias("difference"),
        r6("low").alias("low"), r6("high").alias("high"), F.round("p_value", 9).alias("p_value"), "beats", "loss_hmm", "loss_base",
    )


_PAIR = """
pd AS (SELECT series_id, t0, (y = (mom_12_1 > 0)::INT)::INT AS a, (y = coalesce(previous, 0))::INT AS b FROM monthly)"""


@query(
    q.with_(
        *_HEAD, _PAIR,
        select="""SELECT series_id, count(*) AS months, round(avg(a), 6) AS momentum, round(avg(b), 6) AS previous, round(avg(a) - avg(b), 6) + 0.0::DOUBLE AS difference,
        count(*) FILTER (a > b) AS only_momentum, count(*) FILTER (a < b) AS only_previous FROM pd GROUP BY series_id""",
    )
)
def forecast_verdicts(spark, sf_dir):
    """Two simple forecasts of the monthly direction on the same months: how often each is right, and where only one is."""
    rows = learning.monthly_dataset(panels.bars6(spark, sf_dir))
    right = lambda c: (F.col("y") == c).cast("double")
    rows = _kept(rows.select("series_id", "t0", right((F.col("mom_12_1") > 0).cast("int")).alias("a"), right(F.coalesce("previous", F.lit(0))).alias("b")), "forecasts")
    out = resampling.verdicts(rows, ["series_id"], replicates=200)
    return out.select("series_id", "months", r6("mean_a").alias("momentum"), r6("mean_b").alias("previous"), r6("difference").alias("difference"), F.col("only_a").alias("only_momentum"), F.col("only_b").alias("only_previous"))

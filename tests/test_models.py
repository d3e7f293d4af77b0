"""Tuning, serving and learning strategies against plain loops and stated rules."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.operators import backtest, learners, learning, ml_signals, tuning, validation
from panelquant.sources import folders, models

from .test_operators import DAY0, bars_of, labels_of, walk


def sample(n=80, d=3, k=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    score = x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.8, size=n)
    return x, np.searchsorted(np.quantile(score, np.arange(1, k) / k), score)


@pytest.mark.parametrize("k,codes", [(2, {}), (3, {}), (4, {2: [0.0, 1.0, 2.0]})])
@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_logistic_is_at_its_minimum(k, codes, c):
    """No small change of any weight lowers C * log loss + half the squared weights."""
    x, y = sample(90, 3, k)
    if codes:
        x[:, 2] = np.random.default_rng(1).integers(0, 4, len(x))  # code 3 is unknown
    model = learners.fit_logistic(x, y, k, c, codes)
    w = np.array(model["weights"])

    def loss(w):
        z = learners._encoded(x, model) @ w.T
        p = learners._boosted_probability(z)
        return -c * np.log(p[np.arange(len(y)), y]).sum() + 0.5 * (w[:, :-1] ** 2).sum()

    least = loss(w)
    for i, j in itertools.product(range(w.shape[0]), range(w.shape[1])):
        for step in (-1e-3, 1e-3):
            other = w.copy()
            other[i, j] += step
            assert loss(other) >= least - 1e-9


def test_tree_takes_the_best_split_of_all():
    rng = np.random.default_rng(4)
    x, g, h = rng.integers(0, 6, (40, 3)).astype(float), rng.normal(size=40), rng.random(40) + 0.1
    found = learners._Grower(x, 2, 5)._split(np.ones(40, bool), g, h)
    gains = []
    for f in range(3):
        for low, high in itertools.pairwise(sorted(set(x[:, f]))):
            left = x[:, f] <= low
            if min(left.sum(), (~left).sum()) >= 5:
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                gains.append((part(left) + part(~left) - part(np.ones(40, bool)), -f, -(low + high) / 2))
    best = max(gains)
    assert found == pytest.approx((best[0], -best[1], -best[2]))
    nodes = learners._Grower(x, 4, 5).grow(g, h)
    leaf = learners._tree_values(nodes, x)
    assert sum(len(n) == 1 for n in nodes) <= 4 and min((leaf == v).sum() for v in set(leaf)) >= 5
    for v in set(leaf):
        assert v == pytest.approx(-0.05 * g[leaf == v].sum() / (h[leaf == v].sum() + 1))


@pytest.mark.parametrize("k", [2, 3])
def test_boosting_learns_and_stages_are_shorter_fits(k):
    x, y = sample(200, 3, k)
    params = {"leaves": 3, "least": 5, "rounds": 60}
    model = learners.fit("boosted", params, x, y, k, {})
    loss = [-np.log(p[np.arange(len(y)), y]).mean() for p in learners.boosted_stages(model, x, [1, 20, 60])]
    assert loss[0] > loss[1] > loss[2] and loss[0] < math.log(k) + 0.1
    short = learners.fit("boosted", params | {"rounds": 20}, x, y, k, {})
    assert np.array_equal(learners.probabilities(short, x), learners.floored(list(learners.boosted_stages(model, x, [20]))[0], range(k), k))


@pytest.mark.parametrize("kind,params", [("logistic", {"c": 1.0}), ("boosted", {"leaves": 3, "least": 5, "rounds": 10})])
def test_artifacts_predict_as_the_fit_does(kind, params):
    x, y = sample(60, 3, 3)
    y[y == 1] = 2  # a class that training lacks
    model = learners.fit(kind, params, x, y, 3, {})
    text = learners.artifact(model, "abc")
    p = learners.probabilities(learners.loaded(text), x)
    assert np.array_equal(p, learners.probabilities(model, x)) and text == learners.artifact(learners.loaded(text), "abc")
    assert np.allclose(p.sum(1), 1) and p.min() > 0.9e-4
    alone = learners.fit(kind, params, x, np.full(60, 2), 3, {})
    assert learners.probabilities(alone, x)[0].argmax() == 2
    with pytest.raises(ValueError):
        learners.loaded(json.dumps({"format": "other"}))


def months(n=70, series=("a", "b"), k=2, seed=3):
    rng, rows = random.Random(seed), []
    for s in series:
        for i in range(n):
            x = [rng.gauss(0, 1), rng.gauss(0, 1)]
            t0, t1 = DAY0 + dt.timedelta(days=30 * i), DAY0 + dt.timedelta(days=30 * (i + 1))
            rows.append((s, t0, t1, int((x[0] + rng.gauss(0, 1) > 0) + (k > 2 and x[1] > 0.5)), x))
    return rows


def month_frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, t0 date, t1 date, y int, x array<double>")


def brute_folds(train, folds, embargo):
    """Purged folds of rows (t0, t1, ...) in order."""
    n = len(train)
    sizes = [n // folds + (i < n % folds) for i in range(folds)]
    first = 0
    for size in sizes:
        test = train[first : first + size]
        start, end = test[0][0], max(r[1] for r in test)
        kept = [r for i, r in enumerate(train) if not first <= i < first + size and not (r[0] <= end and r[1] >= start) and not first + size <= i < first + size + embargo]
        first += size
        if kept:
            yield kept, test


def test_nested_walk_forward_matches_plain_loops(spark):
    rows = months()
    samples = month_frame(spark, rows)
    outer = validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), 40, 12, 1)
    grid = [*tuning.LOGISTIC_GRID[1:4], *tuning.BOOSTED_GRID[:3], *tuning.BOOSTED_GRID[9:11]]
    predictions, trials = tuning.nested_walk_forward(samples, outer, grid, 2)
    got = {(r["series_id"], r["t0"]): r for r in predictions.collect()}
    tried = {(r["series_id"], r["fold"], r["setting"]): r for r in trials.collect()}
    roles = {}
    for r in outer.collect():
        roles.setdefault((r["series_id"], r["fold"]), {}).setdefault(r["role"], set()).add(r["t0"])
    assert len(roles) == 6
    fit = lambda params, part: learners.fit(*params, np.array([r[3] for r in part]), np.array([r[2] for r in part]), 2, {})
    for (s, fold), own in roles.items():
        train = [r[1:] for r in rows if r[0] == s and r[1] in own["train"]]
        losses = []
        for i, setting in enumerate(grid):
            loss = []
            for kept, test in brute_folds(train, 5, 1):
                assert not any(a[0] <= max(b[1] for b in test) and a[1] >= test[0][0] for a in kept)
                p = learners.probabilities(fit(setting, kept), np.array([r[3] for r in test]))
                loss += [-math.log(p[j, r[2]]) for j, r in enumerate(test)]
            losses.append(np.mean(loss))
            assert tried[s, fold, i]["inner_log_loss"] == pytest.approx(losses[-1], abs=1e-9)
            assert tried[s, fold, i]["inner_n"] == len(loss)
        best = losses.index(min(losses))
        assert [i for i in range(len(grid)) if tried[s, fold, i]["selected"]] == [best]
        test = [r[1:] for r in rows if r[0] == s and r[1] in own["test"]]
        p = learners.probabilities(fit(grid[best], train), np.array([r[3] for r in test]))
        for r, q in zip(test, p):
            assert got[s, r[0]]["proba"] == pytest.approx(q.tolist()) and got[s, r[0]]["setting"] == best


def test_equal_settings_go_to_the_earlier_and_four_classes_fit(spark):
    samples = month_frame(spark, months(60, ("a",), 4))
    outer = validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), 40, 24, 1)
    grid = [("logistic", {"c": 0.1}), ("logistic", {"c": 0.1}), ("boosted", {"leaves": 3, "least": 5, "rounds": 25})]
    predictions, trials = tuning.nested_walk_forward(samples, outer, grid, 4, {1: [0.0, 1.0]})
    assert not trials.where("setting = 1 and selected").count()
    assert {len(r["proba"]) for r in predictions.collect()} == {4}


def test_inner_rows_come_from_the_outer_training_rows_alone(spark):
    samples = month_frame(spark, months(90))
    outer = validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), 50, 12, 2)
    inner = tuning.inner_roles(outer)
    train = outer.where("role = 'train'").select("series_id", "fold", "t0")
    assert not inner.select("series_id", "fold", "t0").exceptAll(inner.select("series_id", "fold", "t0").join(train, ["series_id", "fold", "t0"])).count()
    assert inner.where("role = 'test'").count() == train.count()


def trained(spark, snapshot="s1", seed=3):
    samples = month_frame(spark, months(60, seed=seed))
    inputs = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=30 * i), 0.1 * i, 0.2 * k) for k, s in enumerate("ab") for i in range(3)], "series_id string, date date, f double, g double")
    fitted = tuning.tuned_models(samples, tuning.BOOSTED_GRID[:2], 2, ["f", "g"]).join(models.serving_inputs(inputs, ["f", "g"]), "series_id")
    out = fitted.withColumns({"name": F.concat(F.lit("m-"), "series_id"), "snapshot_id": F.lit(snapshot), "target": F.lit("direction"), "feature_set": F.lit("base"), "classes": F.lit(2), "metrics": F.lit("{}")})
    path = folders.passing(spark, "trained")
    out.write.parquet(path)
    return spark.read.parquet(path)


def test_registry_versions_are_immutable_and_checked(spark):
    path, log = folders.passing(spark, "registry"), folders.passing(spark, "log")
    assert folders.table(spark, path, models.REGISTRY).count() == 0
    one = trained(spark)
    first = models.register(spark, path, one).collect()
    again = models.register(spark, path, one).collect()
    assert [(r["version"], r["created"]) for r in first] == [(1, True)] * 2 and [(r["version"], r["created"]) for r in again] == [(1, False)] * 2
    models.register(spark, path, trained(spark, "s2"))
    registry = folders.table(spark, path, models.REGISTRY)
    assert sorted((r["name"], r["version"]) for r in models.latest(registry).collect()) == [("m-a", 2), ("m-b", 2)]
    assert models.version(registry, "m-a", 1).count() == 1 and models.version(registry, "m-a", 9).count() == 0
    listed = models.summaries(registry)
    assert "artifact" not in listed.columns and listed.where("artifact_bytes > 100").count() == 4
    rows = models.predict(spark, models.latest(registry), log).collect()
    models.predict(spark, models.latest(registry), log)
    assert folders.table(spark, log, models.LOG).count() == 2 and len(rows) == 2
    for r in rows:
        stored = models.version(registry, r["name"], r["version"]).first()
        want = learners.probabilities(learners.loaded(stored["artifact"]), np.array([stored["serving_features"]]))[0]
        assert r["proba"] == want.tolist() and r["prediction"] == int(want.argmax()) and r["features_sha256"] == stored["features_sha256"]
    models.predict(spark, registry, log)
    assert folders.table(spark, log, models.LOG).count() == 4
    for column, value in (("artifact", F.concat("artifact", F.lit(" "))), ("serving_features", F.array(F.lit(0.0), F.lit(1.0))), ("features", F.array(F.lit("g"), F.lit("f")))):
        with pytest.raises(Exception, match="m-a version 1"):
            models.verified(registry.where("version = 1 and name = 'm-a'").withColumn(column, value)).select("artifact").collect()


def test_incomplete_serving_features_are_an_error(spark):
    rows = spark.createDataFrame([("a", DAY0, 1.0, None)], "series_id string, date date, f double, g double")
    with pytest.raises(Exception, match="incomplete: g"):
        models.serving_inputs(rows, ["f", "g"]).collect()


def test_trial_lines_come_back(spark):
    path = folders.passing(spark, "trials")
    rows = spark.createDataFrame([("a", 1, 0.5, True), ("b", 2, None, False)], "series_id string, setting int, inner_log_loss double, selected boolean")
    models.write_trials(rows, path)
    models.write_trials(rows, path)
    back = models.read_trials(spark, path, "series_id string, setting int, inner_log_loss double, selected boolean")
    assert back.count() == 4 and set(map(tuple, back.collect())) == set(map(tuple, rows.collect()))


def test_regime_samples_look_ahead_for_the_target_only(spark):
    bars = bars_of(spark, walk(700, 8))
    labels = labels_of(spark, [-1] * 300 + [i // 45 % 4 for i in range(400)])
    rows = learning.regime_dataset(bars, labels).orderBy("t0").collect()
    by_day = {r["date"]: r["label"] for r in labels.collect()}
    assert len(rows) > 5
    for before, r in zip([None, *rows], rows):
        own = [by_day[r["t0"] + dt.timedelta(days=i)] for i in range(1, (r["t1"] - r["t0"]).days + 1)]
        assert own.count(r["y"]) == max(own.count(v) for v in set(own)) and r["regime_rules"] == by_day[r["t0"]]
        if before and before["t1"] == r["t0"]:
            assert r["previous"] == before["y"]


# Learning strategies ------------------------------------------------------------------------------------------


def wavy(n=400):
    rng, out = random.Random(2), [100.0]
    for i in range(n - 1):
        out.append(out[-1] * (1 + (0.004 if i // 8 % 2 else -0.004) + rng.gauss(0, 0.001)))
    return out


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_learning_signal_is_flat_before_its_cutoff_and_good_after_it(spark, kind):
    bars = bars_of(spark, wavy())
    rows = ml_signals.ml_direction(bars, 0.6, kind).orderBy("date").collect()
    assert len(rows) == 400 and not any(r["signal"] for r in rows[:240]) and any(r["signal"] for r in rows[240:])
    closes = [r["close"] for r in bars.orderBy("date").collect()]
    hits = [(rows[i]["signal"] == 1) == (closes[i + 1] > closes[i]) for i in range(240, 399)]
    assert np.mean(hits) > 0.75
    curve = backtest.run_backtest(bars, ml_signals.ml_direction(bars, 0.6, kind), 0).orderBy("date").collect()
    assert curve[-1]["equity_curve"] > 1.2 * curve[-1]["benchmark_curve"]


def test_training_rows_end_before_the_cutoff(spark):
    rows = ml_signals.direction_rows(bars_of(spark, walk(200)), 0.5).orderBy("date").collect()
    last = max(r["date"] for r in rows if r["role"] == "train")
    assert last == DAY0 + dt.timedelta(days=98) and min(r["date"] for r in rows if r["role"] == "test") == DAY0 + dt.timedelta(days=100)


def test_a_model_each_regime_falls_back_where_rows_are_few(spark):
    bars, labels = bars_of(spark, wavy()), labels_of(spark, [0] * 330 + [1] * 70)
    rows = ml_signals.direction_rows(bars, 0.6, labels)
    plain = {r["date"]: r["p_up"] for r in ml_signals.direction_predictions(rows.withColumn("label", F.lit(-1)), mode="conditional").collect()}
    own = {r["date"]: r["p_up"] for r in ml_signals.direction_predictions(rows, mode="conditional", least=100).collect()}
    assert own == pytest.approx(plain)  # regime 0 is all of training, regime 1 none of it
    none = ml_signals.direction_predictions(rows, mode="conditional", least=10_000)
    assert {r["date"]: r["p_up"] for r in none.collect()} == pytest.approx(plain)
    assert ml_signals.direction_predictions(rows, mode="feature").count() == len(plain)
    with pytest.raises(ValueError):
        ml_signals.direction_predictions(rows, mode="other")


def test_learning_anew_in_each_fold_uses_its_first_rows_alone(spark):
    bars = bars_of(spark, wavy(330))
    build = lambda b: ml_signals.CATALOG["ml_direction"].signals(b, train_share=ml_signals.refit_share(200, 50))
    folds = validation.refit_signals(bars, build, 200, 50)
    assert not folds.where("signal <> 0 and not is_test").count() and folds.where("is_test and signal <> 0").count()
    own = validation.training_windows(bars, 200, 50).where("fold = 1").select("series_id", "date", "close")
    want = {r["date"]: r["signal"] for r in build(own).collect()}
    assert {r["date"]: r["signal"] for r in folds.where("fold = 1").collect()} == want


def test_one_learned_series_leaves_the_others_alone(spark):
    both = bars_of(spark, wavy()).unionByName(bars_of(spark, walk(20), "short"))
    rows = ml_signals.ml_direction(both)
    assert rows.where("series_id = 'short' and signal <> 0").count() == 0 and rows.where("series_id = 'short'").count() == 20

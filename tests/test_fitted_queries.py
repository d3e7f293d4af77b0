"""Queries of fitted models, which SQL can't express, against fits and sums in plain NumPy and Python."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelquant.operators import learning, regimes, validation
from panelquant.plans import models
from panelquant.plans.runs import DAILY_COLUMNS
from panelquant.sources import panels


@pytest.fixture(scope="module")
def daily(spark, sf_dir):
    """The daily table as arrays: standardised features by the training rows, label, series and whether a row is tested."""
    rows = learning.daily_table(panels.bars6(spark, sf_dir)).select("series_id", "role", "y", *DAILY_COLUMNS).toPandas()
    train = (rows["role"] == "train").to_numpy()
    x = rows[DAILY_COLUMNS].to_numpy(float)
    x = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    return x, rows["y"].to_numpy(int), rows["series_id"].to_numpy(), train


def logistic_fit(x, y, penalty):
    """Newton's method on the mean log loss and penalty / 2 times the squared weights; the intercept comes last and is free."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / len(x) + ridge, a.T @ (p - y) / len(x) + ridge @ w)
    return w


def test_top_importances_are_those_of_a_plain_fit(spark, sf_dir, daily):
    x, y, _, train = daily
    w = logistic_fit(x[train], y[train], 1 / train.sum())[:-1]
    want = dict(zip(DAILY_COLUMNS, w))
    got = entry.queries()["top_importances"](spark, sf_dir).collect()
    assert len(got) == 5
    for r in got:
        assert r["importance"] == pytest.approx(want[r["feature"]], abs=0.02 * np.abs(w).max())
    assert min(abs(want[r["feature"]]) for r in got) >= np.sort(np.abs(w))[-5] - 0.02 * np.abs(w).max()


def test_direction_scores_are_those_of_a_plain_fit(spark, sf_dir, daily):
    """The logistic model's accuracy and area under the curve, by pairs; the forest's lie within their bounds."""
    x, y, series, train = daily
    w = logistic_fit(x[train], y[train], 1 / train.sum())
    z = x @ w[:-1] + w[-1]
    got = {(r["model"], r["series_id"]): r for r in entry.queries()["ml_direction"](spark, sf_dir).collect()}
    names = sorted(set(series))
    assert sorted(got) == sorted((m, s) for m in ("logistic", "forest") for s in names)
    for s in names:
        own = ~train & (series == s)
        ones, zeros = z[own & (y == 1)], z[own & (y == 0)]
        pairs = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
        r = got["logistic", s]
        assert (r["positives"], r["negatives"]) == (len(ones), len(zeros))
        assert r["auc"] == pytest.approx(pairs, abs=0.01)
        assert r["accuracy"] == pytest.approx(((z[own] > 0) == (y[own] == 1)).mean(), abs=0.02)
        assert 0 <= got["forest", s]["auc"] <= 1 and got["forest", s]["positives"] == len(ones)


def test_deflated_probability_is_the_normal_distribution_of_z(spark, sf_dir):
    z = {(r["run_id"], r["series_id"]): r["z"] for r in entry.queries()["deflated_sharpe"](spark, sf_dir).collect()}
    got = entry.queries()["deflated_sharpe_probability"](spark, sf_dir).collect()
    assert len(got) == len(z)
    for r in got:
        assert r["dsr"] == pytest.approx((1 + math.erf(z[r["run_id"], r["series_id"]] / math.sqrt(2))) / 2, abs=1e-5)


def test_mcnemar_p_value_sums_the_tail(spark, sf_dir):
    cells = {r["series_id"]: (r["only_a"], r["only_b"]) for r in entry.queries()["wilson_mcnemar"](spark, sf_dir).collect()}
    got = {r["series_id"]: r["p_value"] for r in entry.queries()["mcnemar_p_value"](spark, sf_dir).collect()}
    assert got.keys() == cells.keys()
    for s, (a, b) in cells.items():
        log_terms = [math.lgamma(a + b + 1) - math.lgamma(k + 1) - math.lgamma(a + b - k + 1) - (a + b) * math.log(2) for k in range(min(a, b) + 1)]
        assert got[s] == pytest.approx(min(1.0, 2 * sum(map(math.exp, log_terms))), abs=1e-8)


@pytest.mark.parametrize("fit", [regimes.kmeans_labels, regimes.mixture_labels])
def test_clusters_are_found_and_scored(spark, fit):
    """Three clouds far apart: rows share a label just if they share a cloud, rows outside the fit too; scores add up to 1."""
    rng = np.random.default_rng(2)
    cloud = rng.integers(0, 3, 300)
    x = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]])[cloud] + rng.normal(scale=0.5, size=(300, 2))
    rows = spark.createDataFrame([(f"s{i}", i < 210, float(a), float(b)) for i, (a, b) in enumerate(x)], "series_id string, fit boolean, a double, b double")
    rows = rows.withColumn("date", F.lit("2020-01-01").cast("date"))
    got = {int(r["series_id"][1:]): r for r in fit(rows, ("a", "b")).collect()}
    assert len({(got[i]["label"], c) for i, c in enumerate(cloud)}) == 3
    assert all(sum(r["prob"]) == pytest.approx(1.0) and int(np.argmax(r["prob"])) == r["label"] for r in got.values())


@pytest.mark.parametrize("name", ["kmeans_regimes", "gmm_regimes", "supervised_regimes"])
def test_fitted_regimes_label_every_complete_day(spark, sf_dir, name):
    """Labels run from calm to wild within a series, and their days add up to the days with all features."""
    from panelquant.plans import models

    _, fit = models._fit_rows(spark, sf_dir)
    want = {r["series_id"]: r["count"] for r in fit.groupBy("series_id").count().collect()}
    got = {}
    for r in entry.queries()[name](spark, sf_dir).collect():
        got.setdefault(r["series_id"], []).append(r)
    assert {s: sum(r["days"] for r in own) for s, own in got.items()} == want
    for own in got.values():
        own.sort(key=lambda r: r["label"])
        assert [r["label"] for r in own] == list(range(len(own)))
        vols = [r["vol"] for r in own if r["vol"] is not None]
        assert vols == sorted(vols)


def test_nested_fits_of_few_samples_are_dealt_to_few_tasks(spark, monkeypatch):
    rng, parts = np.random.default_rng(2), []
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=30 * k)
    x = rng.normal(size=(60, 2))
    rows = [("s", day(k), day(k + 1), int(x[k, 0] + rng.normal() > 0), *x[k].tolist()) for k in range(60)]
    samples = spark.createDataFrame(rows, "series_id string, t0 date, t1 date, y int, a double, b double").repartition(8)
    roles = validation.walk_forward_folds(samples.select("series_id", "t0", "t1"), 24, 12)
    fit = learning.Pipeline.fit
    monkeypatch.setattr(learning.Pipeline, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(learning, "FIT_ROWS", 100)
    found = learning.nested_walk_forward(samples, F.broadcast(roles), ["a", "b"], (0.1, 1.0)).collect()
    tested = roles.where("role = 'test'").count()
    kept = roles.count()
    assert len(found) == tested and {r["chosen"] for r in found} <= {0.1, 1.0}
    assert parts and max(parts) <= -(-kept // 100) < 8
    assert np.mean([r["y"] == r["predicted"] for r in found]) > 0.6


def test_monthly_samples_read_the_transactions_once(spark, sf_dir):
    for rows in models._monthly(spark, sf_dir):
        plan = rows._jdf.queryExecution().withCachedData()
        leaves = plan.collectLeaves()
        assert {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())} == {"InMemoryRelation"}

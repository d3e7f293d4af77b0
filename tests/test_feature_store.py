"""Stored fitted features, first days out of sample, and verdicts on paired forecasts."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.operators import indicators, regimes, resampling
from panelquant.sources import features, folders

from .test_operators import DAY0, bars_of, walk

COLUMNS = ("vol_20d", "trend_60d")
SMALL = {"columns": COLUMNS, "first": 120, "every": 60}


def day(i):
    return DAY0 + dt.timedelta(days=i)


def test_a_second_call_fits_nothing(spark, monkeypatch):
    bars = bars_of(spark, walk(420, 5)).unionByName(bars_of(spark, walk(400, 6), "b"))
    path = folders.passing(spark, "states")
    first = sorted(features.hmm_features(spark, path, bars, **SMALL).collect())
    fit, fitted = regimes.fit_hmm, []
    monkeypatch.setattr(regimes, "fit_hmm", lambda plan, *a, **k: fitted.append(sorted(r[0] for r in plan.select("series_id").distinct().collect())) or fit(plan, *a, **k))
    assert sorted(features.hmm_features(spark, path, bars, **SMALL).collect()) == first and not fitted
    more = bars.unionByName(bars_of(spark, walk(380, 7), "c"))
    got = features.hmm_features(spark, path, more, **SMALL)
    assert fitted == [["c"]] and sorted(r for r in got.collect() if r["series_id"] != "c") == first
    changed = bars.withColumn("close", F.when((F.col("series_id") == "b") & (F.col("date") == day(399)), F.col("close") * 1.01).otherwise(F.col("close")))
    features.hmm_features(spark, path, changed, **SMALL)
    assert fitted[1:] == [["b"]]
    features.hmm_features(spark, path, bars, **(SMALL | {"states": 2}))
    assert fitted[2:] == [["a", "b"]]


def test_states_go_from_calm_to_wild_and_come_from_earlier_days(spark):
    calm, wild = walk(150, 1, dev=0.003), walk(150, 2, dev=0.03)
    closes = [*calm, *[c * calm[-1] / wild[0] for c in wild]] * 2
    rows = features.walk_forward_hmm(bars_of(spark, closes), ("vol_20d",), 2, 200, 50).orderBy("date").collect()
    vol = {r["date"]: r["vol_20d"] for r in indicators.regime_features(bars_of(spark, closes)).collect()}
    by_state = {s: np.mean([vol[r["date"]] for r in rows if r["regime_hmm"] == s]) for s in (0, 1)}
    assert by_state[0] < by_state[1]
    assert all(r["regime_hmm"] == int(np.argmax(r["prob"])) and sum(r["prob"]) == pytest.approx(1) for r in rows)
    assert min(r["date"] for r in rows) == rows[0]["causal_from"]
    cut = rows[120]["date"]
    shorter = features.walk_forward_hmm(bars_of(spark, closes).where(F.col("date") <= F.lit(cut)), ("vol_20d",), 2, 200, 50).orderBy("date").collect()
    assert [r["regime_hmm"] for r in shorter] == [r["regime_hmm"] for r in rows[: len(shorter)]] and len(shorter) == 121


def test_first_day_out_of_sample_is_the_later_one(spark):
    ends = spark.createDataFrame([("a", day(9), day(10)), ("b", day(9), day(10)), ("c", day(9), day(10))], "series_id string, learn_end date, oos_from date")
    causal = spark.createDataFrame([("a", day(30)), ("b", day(3)), ("c", None)], "series_id string, causal_from date")
    got = {r["series_id"]: r["oos_from"] for r in features.out_of_sample_from(ends, causal).collect()}
    assert got == {"a": day(30), "b": day(10), "c": None}
    labels = spark.createDataFrame([("a", day(i), i < 5) for i in range(8)] + [("b", day(0), True)], "series_id string, date date, fit boolean")
    assert {r["series_id"]: r["causal_from"] for r in features.causal_starts(labels).collect()} == {"a": day(5), "b": None}


def test_attached_states_are_causal(spark):
    stored = spark.createDataFrame([("k", "a", day(i), i % 2, [0.2, 0.3, 0.5], day(3)) for i in range(6)], features.HMM)
    samples = spark.createDataFrame([("a", day(i), i) for i in range(7)], "series_id string, t0 date, v int")
    rows = features.attached(samples, stored).orderBy("t0").collect()
    assert [r["regime_hmm"] for r in rows] == [None, None, None, 1.0, 0.0, 1.0, None] and rows[4]["hmm_p2"] == 0.5 and len(rows) == 7


def test_verdicts_match_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(s, day(i), float(rng.random() < p), float(rng.random() < 0.5)) for s, p in (("good", 0.8), ("same", 0.5)) for i in range(90)]
    got = {r["series_id"]: r for r in resampling.verdicts(spark.createDataFrame(rows, "series_id string, t0 date, a double, b double"), ["series_id"], replicates=300).collect()}
    for s in ("good", "same"):
        a, b = (np.array([r[k] for r in rows if r[0] == s]) for k in (2, 3))
        only_a, only_b = int((a > b).sum()), int((a < b).sum())
        n, k = only_a + only_b, min(only_a, only_b)
        p = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        gaps = [np.subtract(a, b)[resampling.sample_indices(0, rep, 90, 6.0)].mean() for rep in range(300)]
        low, high = np.percentile(gaps, [2.5, 97.5])
        r = got[s]
        assert (r["only_a"], r["only_b"], r["months"]) == (only_a, only_b, 90)
        assert (r["p_value"], r["low"], r["high"], r["difference"]) == pytest.approx((p, low, high, a.mean() - b.mean()))
        assert r["beats"] == (low > 0 and p < 0.05)
    assert got["good"]["beats"] and not got["same"]["beats"]

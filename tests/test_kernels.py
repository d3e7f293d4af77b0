"""Kernels that work through long series in pieces, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.operators import backtest, indicators, regimes


def test_earlier_counts_match_plain_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 33, 400):
        x = rng.integers(0, 20, n).astype(float)
        smaller, equal = indicators.earlier_counts(x)
        assert smaller.tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)]
        assert equal.tolist() == [int((x[:i] == x[i]).sum()) for i in range(n)]


def test_expanding_rank_over_many_batches(spark):
    """Series that end inside and across batches, with nulls and ties."""
    rows = spark.range(3000).select(
        F.concat(F.lit("s"), (F.col("id") % 3)).alias("series_id"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 7919 % 101).cast("double")).alias("v"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "130")
    try:
        got = indicators.expanding_rank(rows, "v", "rk", 5).orderBy("series_id", "date").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    past = {}
    for r in got:
        own = past.setdefault(r["series_id"], [])
        if r["v"] is None:
            assert r["rk"] is None
            continue
        own.append(r["v"])
        want = (sum(x < r["v"] for x in own) + (own.count(r["v"]) + 1) / 2) / len(own) if len(own) >= 5 else None
        assert r["rk"] == (pytest.approx(want) if want is not None else None)


def test_smoothing_equals_the_recursion_on_long_series(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit("s").alias("series_id"),
        F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.array(F.sin("id"), F.cos(F.col("id") * 3), F.lit(0.25)).alias("prob"),
    )
    got = regimes.smoothed_probabilities(rows, span=9).orderBy("date").collect()
    x = np.array([r["prob"] for r in got])
    y = x[0]
    for t, r in enumerate(got):
        y = y * (1 - 0.2) + x[t] * 0.2 if t else y
        assert np.abs(np.array(r["smooth_prob"]) - y).max() < 1e-12
        assert r["label"] == int(np.argmax(r["smooth_prob"]))
    assert len(got) == n


@pytest.mark.parametrize("alpha", [1.0, 0.999, 0.5, 1e-4])
def test_smoothing_goes_on_across_pieces(alpha):
    x = np.random.default_rng(1).random((5000, 2))
    whole = regimes.exponential_mean(x, alpha)
    first = regimes.exponential_mean(x[:777], alpha)
    assert np.allclose(np.concatenate([first, regimes.exponential_mean(x[777:], alpha, first[-1])]), whole, atol=1e-13)


def test_curves_compound_without_a_window_over_all_rows(spark):
    rows = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.when(F.col("id") > 70, F.col("id") % 5 / 100.0).alias("r"))
    out = backtest.compounded(rows, {"curve": 1 + F.col("r")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("block" in line for line in plan.splitlines() if "Window [" in line)
    curve = 1.0
    for r in out.orderBy("date").collect():
        curve *= 1 + (r["r"] or 0.0)
        assert r["curve"] == (None if r["r"] is None and curve == 1.0 else pytest.approx(curve))

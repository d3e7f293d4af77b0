"""Legs, compared strategies, stitched folds and label determinacy against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from panelquant.operators import backtest, comparison, learning, portfolio, signals

from .test_operators import DAY0, bars_of, walk


def weights_of(spark, names=4, days=150, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(names):
        closes, weight = walk(days, seed + k, dev=0.01 * (k + 1)), 0.0
        for i in range(days):
            day = DAY0 + dt.timedelta(days=i)
            if (day + dt.timedelta(days=1)).month != day.month or i == days - 1:
                weight = rng.choice([-0.5, 0.0, 0.5])
            rows.append((f"n{k}", day, None if rng.random() < 0.05 else closes[i], weight))
    return rows, spark.createDataFrame(rows, "series_id string, date date, close double, weight double")


def by_name(rows):
    out = {}
    for name, *rest in rows:
        out.setdefault(name, []).append(rest)
    return out


def daily(closes):
    return [None] + [b / a - 1 if a is not None and b is not None else None for a, b in zip(closes, closes[1:])]


def test_legs_add_up_to_the_portfolio(spark):
    _, weights = weights_of(spark)
    whole = {r["date"]: r for r in backtest.run_portfolio_backtest(weights).collect()}
    legs = portfolio.leg_returns(weights).collect()
    assert len(legs) == len(whole) == 150
    for r in legs:
        assert r["long_gross"] + r["short_gross"] == pytest.approx(whole[r["date"]]["gross_return"], abs=1e-12)
        assert r["long_cost"] + r["short_cost"] == pytest.approx(whole[r["date"]]["cost"], abs=1e-12)
        assert r["strategy_return"] == pytest.approx(whole[r["date"]]["strategy_return"], abs=1e-12)


def test_a_change_of_sign_trades_in_both_legs(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), 100.0, w) for i, w in enumerate([1.0, -1.0, -1.0, 0.0])]
    found = portfolio.leg_returns(spark.createDataFrame(rows, "series_id string, date date, close double, weight double"), 10).orderBy("date").collect()
    assert [(round(r["long_cost"] * 1e3, 9), round(r["short_cost"] * 1e3, 9)) for r in found] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_beta_neutral_weights_match_a_loop(spark):
    rows, weights = weights_of(spark)
    names = by_name(rows)
    days = [r[0] for r in names["n0"]]
    r = {k: daily([x[1] for x in v]) for k, v in names.items()}
    market = [np.mean(own) if (own := [r[k][i] for k in names if r[k][i] is not None]) else None for i in range(len(days))]

    def beta(k, i):
        pairs = [(market[j], r[k][j]) for j in range(max(0, i - 39), i + 1) if r[k][j] is not None]
        return np.polyfit(*zip(*pairs), 1)[0] if len(pairs) >= 20 else None

    scale, expected = 1.0, {}
    for i, day in enumerate(days):
        if i == len(days) - 1 or days[i + 1].month != day.month:
            held = {k: v[i][2] for k, v in names.items() if v[i][2]}
            if held:
                betas = {k: beta(k, i) for k in held}
                scale = 1.0
                if None not in betas.values():
                    long, short = (sum(w * betas[k] for k, w in held.items() if w * s > 0) for s in (1, -1))
                    scale = -long / short if long > 0 and short < 0 else 1.0
        for k, v in names.items():
            expected[k, day] = v[i][2] * (scale if v[i][2] < 0 else 1.0)
    found = {(x["series_id"], x["date"]): x["weight"] for x in portfolio.beta_neutral(weights, 40).collect()}
    assert found == pytest.approx(expected, abs=1e-9)
    assert any(abs(expected[k, d] - names[k][i][2]) > 1e-6 for k in names for i, d in enumerate(days))


def test_neutral_legs_have_equal_betas_and_empty_panels_none(spark):
    _, weights = weights_of(spark)
    rows = portfolio.trailing_betas(portfolio.beta_neutral(weights, 40), 40).where("date = '2020-04-30'").collect()
    net = sum(r["weight"] * r["beta"] for r in rows if r["weight"])
    scaled = {r["scale"] for r in rows}
    assert len(scaled) == 1 and (net == pytest.approx(0, abs=1e-9) or scaled == {1.0})
    assert portfolio.beta_neutral(weights.limit(0)).count() == 0 == portfolio.leg_returns(weights.limit(0)).count()


def test_a_failing_strategy_is_a_row(spark):
    bars = bars_of(spark, walk(300, 2)).unionByName(bars_of(spark, walk(300, 9), "b"))
    runs = [("fast", "momentum", {"lookback": 5}), ("typo", "momentum", {"lookbak": 5}), ("none", "nothing", {}), ("text", "momentum", {"lookback": "x"})]
    rows = comparison.comparison(bars, runs).collect()
    assert sorted((r["run_id"], r["series_id"]) for r in rows) == sorted((k, s) for k in ("buy_and_hold", "fast", "typo", "none", "text") for s in "ab")
    for r in rows:
        failed = r["run_id"] in ("typo", "none", "text")
        assert (r["error"] is not None) == failed == (r["oos_sharpe"] is None)
        assert (r["deflated_sharpe"] is None) == (r["run_id"] != "fast")
        assert r["n_trials"] == 4
    assert "lookbak" in next(r["error"] for r in rows if r["run_id"] == "typo")
    assert [r["z"] is None for r in rows] == sorted(r["z"] is None for r in rows)
    with pytest.raises(ValueError):
        comparison.comparison(bars, [*runs, ("fast", "momentum", {})])
    with pytest.raises(ValueError):
        comparison.comparison(bars, [("buy_and_hold", "momentum", {})])


def test_without_candidates_the_benchmark_stands_alone(spark):
    rows = comparison.comparison(bars_of(spark, walk(100)), []).collect()
    assert [(r["run_id"], r["z"], r["error"]) for r in rows] == [("buy_and_hold", None, None)]


def test_luck_and_the_benchmark_lower_z(spark):
    bars = bars_of(spark, walk(400, 4))
    one = comparison.comparison(bars, [("m", "momentum", {})]).where("run_id = 'm'").first()
    two = comparison.comparison(bars, [("m", "momentum", {}), ("x", "nothing", {})]).where("run_id = 'm'").first()
    assert two["z"] < one["z"] and two["oos_sharpe"] == one["oos_sharpe"]
    held = comparison.comparison(bars, [("m", "constant", {"exposure": 1.0})]).where("run_id = 'm'").first()
    assert held["z"] == pytest.approx(0, abs=1e-9) and held["deflated_sharpe"] == pytest.approx(0.5)


def test_stitched_curve_matches_a_loop(spark):
    from pyspark.sql import functions as F

    closes = walk(230, 8)
    bars = bars_of(spark, closes)
    rows = backtest.run_backtest(bars, signals.momentum(bars, 5).withColumn("run_id", F.lit("m")))
    daily_rows = [r["strategy_return"] or 0.0 for r in rows.orderBy("date").collect()]
    first = DAY0 + dt.timedelta(days=121)
    found = comparison.stitched_report(rows, 100, 20, F.lit(first)).first()
    folds = [(100 + 20 * k, 120 + 20 * k) for k in range(6)]
    able = [f for f in folds if f[0] >= 121]
    chained = [x for a, b in able for x in daily_rows[a:b]]
    each = [np.mean(daily_rows[a:b]) / np.std(daily_rows[a:b], ddof=1) * 252**0.5 if np.std(daily_rows[a:b]) > 0 else 0.0 for a, b in able]
    assert (found["folds"], found["scored"], found["n"]) == (6, 4, 80)
    assert found["total_return"] == pytest.approx(np.prod(1 + np.array(chained)) - 1)
    assert found["mean_sharpe"] == pytest.approx(np.mean(each)) and found["worst_sharpe"] == pytest.approx(min(each))
    assert found["share_positive"] == pytest.approx(np.mean(np.array(each) > 0))
    assert comparison.stitched_report(rows, 100, 20).first()["scored"] == 6
    assert comparison.stitched_report(rows, 100, 20, F.lit(DAY0 + dt.timedelta(days=900))).count() == 0


def test_known_shares_match_a_loop(spark):
    bars = bars_of(spark, walk(80))
    day = lambda i: DAY0 + dt.timedelta(days=i)
    data = [("a", day(5), day(25), 1.0, 1, 0), ("a", day(25), day(70), 2.0, 1, 1), ("a", day(70), day(79), 3.0, 3, 3)]
    samples = spark.createDataFrame(data, "series_id string, t0 date, t1 date, regime_rules double, y int, previous int")
    found = learning.label_determinacy(bars, samples, {"trend": 30, "vol": 10}).first()
    known = lambda w: np.mean([np.mean([max((w - k) / w, 0) for k in range(1, m + 1)]) for m in (20, 45, 9)])
    assert (found["samples"], found["decision_agrees"], found["previous_agrees"]) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert found["known_trend"] == pytest.approx(known(30)) and found["known_vol"] == pytest.approx(known(10))

"""Identities and edge cases of the analytics operators on small tables."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.functions.columns import cagr, rounded_mean, sharpe
from panelquant.operators import adaptive, backtest, indicators, learning, regimes, reports, resampling, signals, validation
from panelquant.sources import panels, snapshots

DAY0 = dt.date(2020, 1, 1)


def bars_of(spark, closes, series="a"):
    rows = [(series, DAY0 + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, date date, close double")


def signal_of(spark, values, series="a"):
    rows = [(series, DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, signal double")


def labels_of(spark, values, series="a"):
    rows = [(series, DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, label int")


def walk(n, seed=1, drift=0.0005, dev=0.012):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rng.gauss(drift, dev)))
    return out


def test_costs_follow_position_changes(spark):
    values = [0, 0, 1, 1, 0.4, 0.5, 0.5]
    rows = backtest.run_backtest(bars_of(spark, [100] * 7), signal_of(spark, values), 10).orderBy("date").collect()
    assert [r["position"] for r in rows] == [0, *values[:-1]]
    assert [round(r["cost"] * 1e4, 6) for r in rows] == [0, 0, 0, 10, 0, 6, 1]
    assert rows[0]["strategy_return"] is None and rows[0]["equity_curve"] is None


def test_buy_and_hold_is_the_benchmark(spark):
    rows = backtest.run_backtest(bars_of(spark, walk(50)), signal_of(spark, [1] * 50), 0).orderBy("date").collect()
    assert rows[-1]["equity_curve"] == pytest.approx(rows[-1]["benchmark_curve"])


def test_same_day_signal_needs_foresight(spark):
    closes = walk(400, 3)
    up = [float(b > a) for a, b in zip(closes, closes[1:])] + [0.0]
    bars = bars_of(spark, closes)
    value = lambda s: reports.full_report(backtest.run_backtest(bars, s, 0), ["series_id"]).first()["sharpe_ratio"]
    assert value(signal_of(spark, up)) > 8
    assert value(signal_of(spark, [0.0, *up[:-1]])) < 3


def test_rsi_of_straight_rise_is_100(spark):
    bars = indicators.with_returns(bars_of(spark, np.linspace(100, 200, 60)))
    from panelquant.functions.columns import ordered

    rows = bars.select("date", indicators.rsi(F.col("close"), F.col("delta"), 14, ordered()).alias("x")).orderBy("date").collect()
    assert rows[13]["x"] is None and all(r["x"] == 100 for r in rows[14:])


@pytest.mark.parametrize("start,end,n,want", [(1.0, 0.0, 10, -1.0), (0.0, 1.0, 10, 0.0), (1.0, 2.0, 1, 0.0), (1.0, 300.0, 2, math.exp(700) - 1)])
def test_cagr_edges(spark, start, end, n, want):
    row = spark.range(1).select(cagr(F.lit(start), F.lit(end), F.lit(n)).alias("x")).first()
    assert row["x"] == pytest.approx(want)


def test_sharpe_of_constant_returns_is_zero(spark):
    assert spark.createDataFrame([(0.01,)] * 30, "r double").agg(sharpe(F.col("r")).alias("x")).first()["x"] == 0.0


def test_expanding_rank_matches_brute_force(spark):
    rng = random.Random(4)
    values = [None if rng.random() < 0.1 else float(rng.randrange(6)) for _ in range(120)]
    rows = [("a", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, date date, v double")
    got = [r["rk"] for r in indicators.expanding_rank(df, "v", "rk", 3).orderBy("date").collect()]
    past = []
    for v, r in zip(values, got):
        if v is None:
            assert r is None
            continue
        past.append(v)
        want = (sum(x < v for x in past) + (sum(x == v for x in past) + 1) / 2) / len(past)
        assert r == (pytest.approx(want) if len(past) >= 3 else None)


def confirm(values, days):
    out, current, pending, streak = [], values[0], None, 0
    for v in values:
        if v == current:
            pending, streak = None, 0
        else:
            pending, streak = (v, streak + 1) if v == pending else (v, 1)
            if streak >= days:
                current, pending, streak = v, None, 0
        out.append(current)
    return out


def test_confirmation_equals_state_machine(spark):
    rng = random.Random(5)
    for seed in range(4):
        values = [rng.randrange(3) for _ in range(60)]
        values = [v for v in values for _ in range(rng.randrange(1, 6))]
        got = regimes.confirmed(labels_of(spark, [-1, *values]), 3).orderBy("date").collect()
        assert [r["label"] for r in got] == [-1, *confirm(values, 3)]


def test_rolling_mode_and_probabilities(spark):
    got = regimes.rolling_mode(labels_of(spark, [2, 1, 1, 2, 2, 0]), 3).orderBy("date").collect()
    assert [r["label"] for r in got] == [2, 1, 1, 1, 2, 2]
    rows = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), [p, 1 - p]) for i, p in enumerate([1.0, 0.0, 0.0, 0.0])], "series_id string, date date, prob array<double>")
    got = regimes.smoothed_probabilities(rows, span=3).orderBy("date").collect()
    assert [r["smooth_prob"][0] for r in got] == pytest.approx([1, 0.5, 0.25, 0.125]) and [r["label"] for r in got] == [0, 0, 1, 1]


def test_episodes_and_transitions(spark):
    labels = labels_of(spark, [-1, 0, 0, 1, 1, 1, 0])
    assert [(r["label"], r["days"]) for r in reports.episodes(labels).orderBy("start").collect()] == [(0, 2), (1, 3), (0, 1)]
    moves = {(r["from"], r["to"]): (r["moves"], r["share"]) for r in reports.transition_matrix(labels, (0, 1)).collect()}
    assert moves == {(0, 0): (1, 0.5), (0, 1): (1, 0.5), (1, 0): (1, 1 / 3), (1, 1): (2, 2 / 3)}


@pytest.mark.parametrize(
    "transform",
    [indicators.daily_features, indicators.regime_features, signals.sma_crossover, signals.momentum, signals.mean_reversion_rsi],
)
@pytest.mark.parametrize("rewrite", [True, False])
def test_nothing_looks_ahead(spark, transform, rewrite):
    bars = bars_of(spark, walk(420))
    cut = str(DAY0 + dt.timedelta(days=330))
    row = validation.lookahead_check(transform, bars, cut, rewrite).first()
    assert row["changed"] == 0 and row["rows"] == 331


def test_lookahead_is_caught(spark):
    row = validation.lookahead_check(indicators.next_day_label, bars_of(spark, walk(50)), str(DAY0 + dt.timedelta(days=30)), False).first()
    assert row["changed"] == 1


def test_split_day_is_in_both_halves(spark):
    rows = validation.halves(bars_of(spark, walk(10)), 0.7, ["series_id"]).groupBy("half").count().collect()
    assert {r["half"]: r["count"] for r in rows} == {"in_sample": 8, "out_of_sample": 3}


def samples_of(spark, n, span):
    rows = [("a", DAY0 + dt.timedelta(days=i), DAY0 + dt.timedelta(days=i + span)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, t0 date, t1 date")


def test_purged_folds_share_no_days(spark):
    for roles in (validation.walk_forward_folds(samples_of(spark, 40, 3), 10, 6), validation.purged_kfold(samples_of(spark, 40, 3), 4, 2)):
        rows = roles.collect()
        for fold in {r["fold"] for r in rows}:
            own = [r for r in rows if r["fold"] == fold]
            tested = [r for r in own if r["role"] == "test"]
            for r in own:
                if r["role"] == "train":
                    assert all(r["t1"] < t["t0"] or r["t0"] > t["t1"] for t in tested)
        assert len({r["t0"] for r in rows if r["role"] == "test"}) == sum(r["role"] == "test" for r in rows)


def test_first_test_block_leaves_enough_samples_after_purging(spark):
    """With labels that end on the next sample's day, one sample is purged, so testing starts one sample later."""
    for span, start in ((0, 10), (1, 11), (3, 13)):
        rows = validation.walk_forward_folds(samples_of(spark, 40, span), 10, 6).where("fold = 0").collect()
        tested, trained = ([r["pos"] for r in rows if r["role"] == role] for role in ("test", "train"))
        assert min(tested) == start and len(trained) == 10
    assert validation.walk_forward_folds(samples_of(spark, 12, 5), 10, 6).count() == 0


def test_label_intervals_are_checked(spark):
    day = lambda i: DAY0 + dt.timedelta(days=i)
    for wrong in ([("a", day(1), day(0))], [("a", day(1), None)], [("a", day(1), day(2)), ("a", day(1), day(3))]):
        rows = [("a", day(-k), day(-k)) for k in range(2, 9)] + wrong
        samples = spark.createDataFrame(rows, "series_id string, t0 date, t1 date")
        for folds in (lambda x: validation.walk_forward_folds(x, 2, 2), lambda x: validation.purged_kfold(x, 2)):
            with pytest.raises(Exception, match="samples need t0 and t1"):
                folds(samples).collect()


def test_refit_windows_cover_each_fold(spark):
    rows = validation.training_windows(bars_of(spark, walk(50)), 20, 10).groupBy("fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {r["fold"]: (r["n"], r["t"]) for r in rows} == {k: (30, 10) for k in range(3)}


def test_bootstrap_kernel_draws_what_the_table_says(spark):
    for block in (20.0, 1.0):
        rows = resampling.bootstrap_index(spark, spark.createDataFrame([(60,)], "n int"), 4, block, 3).orderBy("rep", "pos").collect()
        assert [r["idx"] for r in rows] == [int(i) for rep in range(4) for i in resampling.sample_indices(3, rep, 60, block)]


def test_bootstrap_blocks_follow_the_law(spark):
    n = spark.createDataFrame([(500,)], "n int")
    rows = resampling.bootstrap_index(spark, n, 20, 20.0, 3).orderBy("rep", "pos").collect()
    assert all(0 <= r["idx"] < 500 for r in rows)
    jumps = sum((b["idx"] - a["idx"]) % 500 != 1 for a, b in zip(rows, rows[1:]) if a["rep"] == b["rep"])
    assert 0.03 < jumps / len(rows) < 0.07


def test_newey_west_without_lags_is_the_plain_error(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) for _ in range(200)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, date int, ret double")
    got = resampling.newey_west(rows, ["series_id"], lags=0).first()
    assert got["se"] == pytest.approx(np.std(values) / math.sqrt(200))


def test_auc_counts_ties_half(spark):
    rng = random.Random(7)
    data = [("a", rng.randrange(2), float(rng.randrange(5))) for _ in range(80)]
    got = learning.auc(spark.createDataFrame(data, "k string, y int, score double"), ["k"]).first()["auc"]
    ones, zeros = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]))


def test_best_choice_is_flat_without_profit(spark):
    table = spark.createDataFrame([("a", 0, "x", 90, -1.0), ("a", 0, "y", 90, -2.0), ("a", 1, "x", 90, 1.0), ("a", 1, "y", 90, 1.0), ("a", 2, "x", 9, None)], "series_id string, label int, run_id string, days int, sharpe double")
    assert {r["label"]: r["choice"] for r in adaptive.best_per_regime(table).collect()} == {0: "flat", 1: "x", 2: None}


def test_snapshots_are_stored_once_and_numbered(spark):
    base = snapshots.content_hash(bars_of(spark, [1, 2, 3])).first()["content_sha256"]
    assert base == snapshots.content_hash(bars_of(spark, [1, 2, 3]).repartition(3)).first()["content_sha256"]
    assert base != snapshots.content_hash(bars_of(spark, [1, 2, math.nextafter(3, 4)])).first()["content_sha256"]
    registry = spark.createDataFrame([("m", 1, "s", "h1")], "name string, version int, snapshot_id string, artifact_sha256 string")
    models = spark.createDataFrame([("m", "s", "h1", 1), ("m", "s", "h2", 2), ("n", "s", "h3", 3)], "name string, snapshot_id string, artifact_sha256 string, created_at int")
    got = {(r["name"], r["artifact_sha256"]): r["version"] for r in snapshots.next_versions(registry, models).collect()}
    assert got == {("m", "h2"): 2, ("n", "h3"): 1}


@pytest.mark.parametrize("closes,valid", [([1, 2], True), ([1], False), ([1, 0], False)])
def test_price_quality(spark, closes, valid):
    assert snapshots.price_quality(bars_of(spark, closes)).first()["valid"] == valid


def test_bars_round_trip(spark, tmp_path):
    bars = bars_of(spark, [1, 2, 3]).select("series_id", "date", F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"), "close", F.lit(1).cast("bigint").alias("volume"))
    panels.write_bars(bars, str(tmp_path / "bars"))
    assert panels.read_bars(spark, str(tmp_path / "bars"), start="2020-01-02", end="2020-01-03").count() == 1


def test_planted_regimes_are_found(spark):
    """Three volatility levels in long segments: the hidden Markov model orders and keeps them."""
    rng = np.random.default_rng(8)
    truth = np.repeat([0, 1, 2, 1, 0, 2], 120)
    x = rng.normal(np.array([-2.0, 0.0, 3.0])[truth], 0.5)
    rows = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=i), float(v), "m", True) for i, v in enumerate(x)], "series_id string, date date, f double, model_id string, fit boolean")
    models = regimes.fit_hmm(rows, ["f"], 3)
    model = models.first()
    assert model["steps"] < 100 and sorted(model["means"]) == pytest.approx([-2, 0, 3], abs=0.2)
    for method in ("filter", "smooth", "viterbi"):
        got = [r["label"] for r in regimes.hmm_labels(rows, ["f"], models, method=method).orderBy("date").collect()]
        order = np.argsort(np.argsort(model["means"]))
        assert np.mean(order[got] == truth) > 0.97


def test_expected_states_equal_enumeration():
    """Shares and moves of a batch (series of two lengths, one model with two series) against the sum over all state paths."""
    rng = np.random.default_rng(9)
    k, sizes = 2, [[5], [3], [2, 3]]
    x, real, begins = np.zeros((5, 3, 2)), np.zeros((5, 3), bool), np.ones((5, 3), bool)
    for m, parts in enumerate(sizes):
        x[: sum(parts), m], real[: sum(parts), m] = rng.normal(size=(sum(parts), 2)), True
        begins[1 : sum(parts), m] = False
        for cut in np.cumsum(parts)[:-1]:
            begins[cut, m] = True
    means, variances = rng.normal(size=(3, k, 2)), rng.uniform(0.5, 2, (3, k, 2))
    start, move = rng.dirichlet(np.ones(k), 3), rng.dirichlet(np.ones(k), (3, k))
    gamma, moves, likelihood = regimes._expected(x, real, begins, means, variances, start, move)
    for m, parts in enumerate(sizes):
        begin, want_moves, want_likelihood = 0, np.zeros((k, k)), 0.0
        for n in parts:
            local = np.exp(regimes._local(x[begin : begin + n, m], means[m], variances[m]))
            paths = list(itertools.product(range(k), repeat=n))
            weight = np.array([start[m, p[0]] * np.prod([move[m, a, b] for a, b in zip(p, p[1:])]) * np.prod([local[t, s] for t, s in enumerate(p)]) for p in paths])
            want_likelihood += np.log(weight.sum())
            weight /= weight.sum()
            for t in range(n):
                assert gamma[begin + t, m] == pytest.approx([sum(w for w, p in zip(weight, paths) if p[t] == s) for s in range(k)])
            for w, p in zip(weight, paths):
                for a, b in zip(p, p[1:]):
                    want_moves[a, b] += w
            begin += n
        assert moves[m] == pytest.approx(want_moves) and likelihood[m] == pytest.approx(want_likelihood)
        assert not gamma[begin:, m].any()


def test_daily_means_that_are_ties_round_up_in_any_order(spark):
    rng, rows, expected = random.Random(1), [], {}
    for day in range(20):
        cents = [rng.randint(0, 10) for _ in range(160)]
        cents[0] += 1 - sum(cents) % 2  # an odd sum over 160 rows is half a millionth off; many of the float sums fall short
        rows += [(f"s{day}", DAY0, c / 100, 0.0, 1.0) for c in cents]
        expected[f"s{day}"] = round(100 * (1 + ((20000 * sum(cents) + 160) // 320 / 1e6 - 0.05)), 6)
    table = spark.createDataFrame(rows, "s string, d date, l_discount double, l_tax double, l_quantity double").coalesce(1)
    found = panels.flow_bars(table, F.col("s"), F.col("d")).collect()
    assert {r["series_id"]: r["close"] for r in found} == pytest.approx(expected, abs=1e-9)
    odd = spark.createDataFrame([("a", 1e30), ("a", 2e30), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 0.25), ("d", None)], "k string, x double")
    means = {r["k"]: r["m"] for r in odd.groupBy("k").agg(rounded_mean("x", 1).alias("m")).collect()}
    assert means["a"] == pytest.approx(1.5e30) and math.isnan(means["b"]) and means["c"] is None and means["d"] == 0.3

"""Market-regime labels: rules, fitted mixtures, a hidden Markov model, and their smoothing and naming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import DAYS, last_rows, ordered, rolling, so_far

from .indicators import KEY, by_series, standardized, with_returns

UNKNOWN = -1
RULES = {0: "Calm Uptrend", 1: "Slow Bleed", 2: "Volatile Rally", 3: "Crisis / Selloff"}


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("series_id", "date")]


def complete_rows(features: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Standardised features, and ``ready`` where all of them are there."""
    columns = list(columns or feature_columns(features))
    scaled = standardized(features.select("series_id", "date", *columns), columns)
    ready = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return scaled.withColumn("ready", ready)


def scalable(columns: Sequence[str], least: int = 60, keys: Sequence[str] = KEY) -> Column:
    """Whether every column has an expanding z-score: it is there, ``least`` values have been seen, and not all are equal."""
    own = so_far(ordered(keys))
    each = [F.col(c).isNotNull() & (F.count(c).over(own) >= least) & (F.min(c).over(own) < F.max(c).over(own)) for c in columns]
    return F.coalesce(reduce(lambda a, b: a & b, each), F.lit(False))


def rules_labels(features: DataFrame) -> DataFrame:
    """0 to 3 by volatility rank (0.70) and sign of the 60-day trend; -1 until every feature has a z-score. One pass over the features."""
    rows = features.withColumn("ready", scalable(feature_columns(features)))
    wild, up = F.col("vol_percentile") >= 0.70, F.col("trend_60d") > 0
    label = F.when(~F.col("ready"), UNKNOWN).otherwise(2 * wild.cast("int") + (~up).cast("int"))
    return rows.select("series_id", "date", label.alias("label"))


def confirmed(labels: DataFrame, days: int = 5, keys: Sequence[str] = KEY) -> DataFrame:
    """A new label counts once it has come on ``days`` labelled days in a row; until then the last one holds.

    Days without a label are a partition of their own, so that the others follow one another.
    """
    known = F.coalesce(F.col("label") != UNKNOWN, F.lit(False))
    own = [*keys, "known"]
    w = ordered(own)
    rows = labels.withColumn("known", known).withColumn("new", ~F.lag("label").over(w).eqNullSafe(F.col("label")))
    rows = rows.withColumn("block", F.count_if("new").over(so_far(w)))
    rows = rows.withColumn("streak", F.row_number().over(ordered([*own, "block"])))
    sure = F.last(F.when(F.col("streak") >= days, F.col("label")), ignorenulls=True).over(so_far(w))
    first = F.first("label").over(so_far(w))
    return rows.select(*keys, "date", F.when(F.col("known"), F.coalesce(sure, first)).otherwise(UNKNOWN).alias("label"))


def rolling_mode(labels: DataFrame, window: int = 5, keys: Sequence[str] = KEY) -> DataFrame:
    """The most frequent label of the last ``window`` labelled days, the smallest on ties."""
    rows = labels.withColumn("known", F.coalesce(F.col("label") != UNKNOWN, F.lit(False)))
    mode = F.mode("label", True).over(last_rows(ordered([*keys, "known"]), window))
    return rows.select(*keys, "date", F.when(F.col("known"), mode).otherwise(UNKNOWN).alias("label"))


def exponential_mean(x: np.ndarray, alpha: float, carry: np.ndarray | None = None) -> np.ndarray:
    """y[t] = (1 - alpha) * y[t - 1] + alpha * x[t] along the rows, from y[0] = x[0] or from the last row of the rows before.

    A step is affine in y, and so are blocks of steps: in a block the sum is a running one of
    x / (1 - alpha) ** t, short enough not to overflow, and the last row goes on to the next block.
    """
    keep = 1 - alpha
    block = int(np.clip(200 / -np.log(keep), 1, 4096)) if 0 < keep < 1 else 1
    out = np.empty_like(x)
    for a in range(0, len(x), block):
        own = x[a : a + block]
        power = keep ** np.arange(1, len(own) + 1)[:, None]
        start = own[0] if carry is None else carry  # as the first row's own mean is itself, it may come before it as well
        out[a : a + block] = power * (start + np.cumsum(alpha * own / power, axis=0)) if keep else own
        carry = out[a + len(own) - 1]
    return out


def smoothed_probabilities(rows: DataFrame, column: str = "prob", span: int = 5, keys: Sequence[str] = KEY) -> DataFrame:
    """Exponentially weighted class probabilities (not adjusted) over the whole series, and the label with the largest.

    A series is one pass in date order that keeps the last row's values; arrays of a series are equally long and without nulls.
    """
    alpha = 2.0 / (span + 1)
    kept = [c for c in rows.columns if c not in ("smooth_prob", "label")]

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        last: list[np.ndarray | None] = [None]

        def step(own: pd.DataFrame) -> pd.DataFrame:
            smooth = exponential_mean(np.stack(own[column].to_list()).astype(float), alpha, last[0])
            last[0] = smooth[-1]
            return own[kept].assign(smooth_prob=list(smooth), label=smooth.argmax(1).astype("int32"))

        return step

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return by_series(rows, keys, f"{schema}, smooth_prob array<double>, label int", start)


def quadrant(trend: Column, level: Column) -> Column:
    """Name of a centroid by its trend and its volatility rank."""
    band = F.when(level >= 0.66, "high").when(level >= 0.33, "mid").otherwise("low")
    way = F.when(trend > 0.02, "up").when(trend < -0.02, "down").otherwise("flat")
    # fixed values
    names = {
        "low up": "Calm Uptrend", "low flat": "Quiet Range", "low down": "Slow Bleed",
        "mid up": "Steady Uptrend", "mid flat": "Choppy", "mid down": "Grinding Down",
        "high up": "Volatile Rally", "high flat": "Turbulent", "high down": "Crisis / Selloff",
    }
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.concat_ws(" ", band, way)]


def order_and_name(labels: DataFrame, features: DataFrame, keys: Sequence[str] = KEY, fit_end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(relabelled rows, names): labels renumbered from the calmest to the wildest by mean volatility.

    With ``fit_end`` only days up to it decide; a label without such days comes last.
    """
    rows = labels.where(F.col("label") != UNKNOWN).join(features, ["series_id", "date"], "left")
    inside = F.col("date") <= F.lit(fit_end).cast("date") if fit_end else F.lit(True)
    mean = lambda c: F.avg(F.when(inside, F.col(c)))
    centres = rows.groupBy(*keys, "label").agg(
        mean("vol_20d").alias("vol"), mean("trend_60d").alias("trend"), mean("vol_percentile").alias("level")
    )
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("vol"), "label")
    centres = centres.withColumn("new_label", F.row_number().over(order) - 1)
    base = quadrant(F.coalesce("trend", F.lit(0.0)), F.coalesce("level", F.lit(0.5)))
    centres = centres.withColumn("base", base)
    same = F.count("*").over(Window.partitionBy(*keys, "base"))
    long_name = F.concat("base", F.lit(" ("), F.round(F.col("vol") * 100).cast("int").cast("string"), F.lit("% vol)"))
    names = centres.withColumn("name", F.when((same > 1) & F.col("vol").isNotNull(), long_name).otherwise(F.col("base")))
    relabelled = labels.join(centres.select(*keys, "label", "new_label"), [*keys, "label"], "left")
    relabelled = relabelled.select(*[c for c in labels.columns if c != "label"], F.coalesce("new_label", F.lit(UNKNOWN)).alias("label"))
    return relabelled, names.select(*keys, F.col("new_label").alias("label"), "name", "vol", "trend", "level")


def fit_rows(scaled: DataFrame, share: float = 0.7, least: int = 30) -> DataFrame:
    """Mark the first ``share`` (at least ``least``) of each series' complete rows with ``fit``."""
    ready = scaled.where("ready")
    n = F.count("*").over(Window.partitionBy("series_id"))
    return ready.withColumn("fit", F.row_number().over(ordered()) <= F.greatest(F.floor(n * share), F.lit(least)))


def _assembled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="x").transform(rows)


def reduced(rows: DataFrame, columns: Sequence[str], components: int = 3) -> DataFrame:
    """Principal components fitted on the rows marked ``fit``, for all rows, as pc_1 to pc_n."""
    centre = rows.where("fit").agg(*[F.avg(c).alias(c) for c in columns]).first()
    rows = rows.withColumns({c: F.col(c) - centre[c] for c in columns})
    rows = _assembled(rows, columns)
    model = PCA(k=components, inputCol="x", outputCol="pc").fit(rows.where("fit"))
    rows = model.transform(rows).withColumn("pc", vector_to_array("pc"))
    return rows.select("series_id", "date", "fit", *[F.col("pc")[i].alias(f"pc_{i + 1}") for i in range(components)])


def kmeans_labels(rows: DataFrame, columns: Sequence[str], k: int = 3, seeds: Sequence[int] = tuple(range(1, 11))) -> DataFrame:
    """k-means fitted on the rows marked ``fit`` (the best of several starts); scores fall with the distance to a centre."""
    rows = _assembled(rows, columns)
    fitted = [KMeans(k=k, seed=s, featuresCol="x", predictionCol="label").fit(rows.where("fit")) for s in seeds]
    model = min(fitted, key=lambda m: m.summary.trainingCost)
    x = vector_to_array("x")
    nearness = [
        1 / (F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) + 1e-9)
        for c in model.clusterCenters()
    ]
    total = reduce(lambda a, b: a + b, nearness)
    return model.transform(rows).select("series_id", "date", "fit", "label", F.array(*[v / total for v in nearness]).alias("prob"))


def mixture_labels(rows: DataFrame, columns: Sequence[str], k: int = 3, seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """A Gaussian mixture fitted on the rows marked ``fit``."""
    rows = _assembled(rows, columns)
    fitted = [GaussianMixture(k=k, seed=s, featuresCol="x", predictionCol="label", probabilityCol="p").fit(rows.where("fit")) for s in seeds]
    model = max(fitted, key=lambda m: m.summary.logLikelihood)
    return model.transform(rows).select("series_id", "date", "fit", "label", vector_to_array("p").alias("prob"))


def supervised_labels(bars: DataFrame, rows: DataFrame, columns: Sequence[str], horizon: int = 20, trees: int = 300) -> DataFrame:
    """Regimes of the next ``horizon`` days, learned from today's features on the rows marked ``fit``."""
    w = ordered()
    ahead = with_returns(bars).withColumns(
        {
            "gain": F.lead("close", horizon).over(w) / F.col("close") - 1,
            "past_vol": rolling(F.stddev_samp, F.col("r"), horizon, w) * F.sqrt(F.lit(float(DAYS))),
        }
    )
    ahead = ahead.withColumn("vol", F.lead("past_vol", horizon).over(w)).select("series_id", "date", "gain", "vol")
    rows = rows.join(ahead, ["series_id", "date"])
    cut = rows.where("fit").groupBy("series_id").agg(F.median("vol").alias("cut"))
    target = 2.0 * (F.col("vol") > F.col("cut")).cast("int") + (F.col("gain") <= 0).cast("int")
    rows = _assembled(rows.join(F.broadcast(cut), "series_id").withColumn("target", target), columns)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="target", probabilityCol="p", predictionCol="label", numTrees=trees, maxDepth=6, minInstancesPerNode=20, seed=1
    )
    model = forest.fit(rows.where("fit and target is not null"))
    out = model.transform(rows)
    return out.select("series_id", "date", "fit", F.col("label").cast("int"), vector_to_array("p").alias("prob"))


# Hidden Markov model: diagonal Gaussians. A task fits a batch of models side by side, each step over time for all of them.

#: Models that a task fits at once; a model's rows are those of a few daily series.
MODEL_BATCH = 32
_MODEL = "means array<double>, variances array<double>, start array<double>, move array<double>, steps int, likelihood double"
_FLOOR = 1e-3


def _local(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log densities (..., k) of observations (..., d) under states (models, k, d) or (k, d)."""
    d = x[..., None, :] - means
    return -0.5 * (d * d / variances + np.log(2 * np.pi * variances)).sum(-1)


def _moments(x: np.ndarray, gamma: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances by the rows' shares in states; a state without rows keeps its own."""
    weight = gamma.sum(0)[..., None]
    some = weight > 1e-8
    safe = np.where(some, weight, 1.0)
    centre = np.where(some, np.einsum("tmk,tmd->mkd", gamma, x) / safe, means)
    d = x[:, :, None, :] - centre
    spread = np.einsum("tmk,tmkd->mkd", gamma, d * d) / safe
    return centre, np.where(some, np.maximum(spread, _FLOOR), variances)


def _mixture_start(x: np.ndarray, real: np.ndarray, k: int, iterations: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of each model's best Gaussian mixture, from quantile starts along each of the first three columns."""
    models, dims = x.shape[1], x.shape[2]
    best = np.full(models, -np.inf)
    means, variances = np.zeros((models, k, dims)), np.ones((models, k, dims))
    for column in range(min(3, dims)):
        own_means, own_variances = np.zeros((models, k, dims)), np.zeros((models, k, dims))
        for m in range(models):
            rows = x[real[:, m], m]
            rank = np.argsort(np.argsort(rows[:, column], kind="stable"), kind="stable") * k // len(rows)
            for j in range(k):
                part = rows[rank == j] if (rank == j).any() else rows
                own_means[m, j], own_variances[m, j] = part.mean(0), np.maximum(part.var(0), _FLOOR)
        share, last = np.full((models, k), 1 / k), np.full(models, -np.inf)
        for _ in range(iterations):
            log_p = _local(x, own_means, own_variances) + np.log(share)
            top = log_p.max(-1, keepdims=True)
            p = np.exp(log_p - top)
            total = p.sum(-1, keepdims=True)
            likelihood = ((np.log(total) + top)[..., 0] * real).sum(0) / real.sum(0)
            if (np.abs(likelihood - last) < tolerance).all():
                break
            last = likelihood
            gamma = p / total * real[..., None]
            own_means, own_variances = _moments(x, gamma, own_means, own_variances)
            share = np.maximum(gamma.sum(0), 1e-9)
            share /= share.sum(-1, keepdims=True)
        better = likelihood > best
        best = np.where(better, likelihood, best)
        means[better], variances[better] = own_means[better], own_variances[better]
    return means, variances


def _expected(x: np.ndarray, real: np.ndarray, begins: np.ndarray, means, variances, start, move) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares of the rows in states, expected moves, log likelihood) of each model, over (time, model)."""
    log_local = _local(x, means, variances)
    top = log_local.max(-1, keepdims=True)
    local = np.where(real[..., None], np.exp(log_local - top), 1.0)
    alpha, scale = np.empty_like(local), np.empty(local.shape[:2])
    for t in range(len(x)):
        before = start if t == 0 else np.where(begins[t, :, None], start, np.matmul(alpha[t - 1][:, None, :], move)[:, 0])
        a = before * local[t]
        scale[t] = np.maximum(a.sum(1), 1e-300)
        alpha[t] = a / scale[t][:, None]
    ahead = np.zeros_like(local)  # of the row after: density times what follows; zero where a series begins
    beta = np.ones_like(local)
    for t in range(len(x) - 2, -1, -1):
        goes_on = ~begins[t + 1, :, None]
        ahead[t + 1] = np.where(goes_on, local[t + 1] * beta[t + 1] / scale[t + 1][:, None], 0.0)
        beta[t] = np.where(goes_on, np.matmul(move, ahead[t + 1][:, :, None])[..., 0], 1.0)
    gamma = alpha * beta
    gamma = gamma / np.maximum(gamma.sum(-1, keepdims=True), 1e-300) * real[..., None]
    moves = move * np.einsum("tmi,tmj->mij", alpha[:-1], ahead[1:])
    return gamma, moves, ((np.log(scale) + top[..., 0]) * real).sum(0)


def _fitted(x: np.ndarray, real: np.ndarray, begins: np.ndarray, k: int, iterations: int, tolerance: float) -> list[tuple]:
    """Expectation maximisation for each model until its log likelihood stands still; rows in the order of _MODEL."""
    models = x.shape[1]
    means, variances = _mixture_start(x, real, k)
    move = np.full((k, k), 0.05 / max(k - 1, 1))
    np.fill_diagonal(move, 0.95)
    state = [means, variances, np.full((models, k), 1 / k), np.repeat(move[None], models, 0)]
    steps, likelihood, open_ = np.zeros(models, int), np.full(models, -np.inf), np.arange(models)
    for step in range(iterations):
        if not len(open_):
            break
        means, variances, start, move = (v[open_] for v in state)
        own, own_real, own_begins = x[:, open_], real[:, open_], begins[:, open_]
        gamma, moves, found = _expected(own, own_real, own_begins, means, variances, start, move)
        first = (gamma * (own_begins & own_real)[..., None]).sum(0)
        rows = moves.sum(-1, keepdims=True)
        state[0][open_], state[1][open_] = _moments(own, gamma, means, variances)
        state[2][open_] = first / first.sum(-1, keepdims=True)
        state[3][open_] = np.where(rows > 0, moves / np.where(rows > 0, rows, 1.0), move)
        last, likelihood[open_], steps[open_] = likelihood[open_], found, step + 1
        with np.errstate(invalid="ignore"):
            still = np.abs(found - last) < tolerance * np.maximum(np.abs(last), 1.0)
        open_ = open_[~(still & np.isfinite(last))]
    return [(*(np.ravel(v[m]) for v in state), int(steps[m]), float(likelihood[m])) for m in range(models)]


def fit_hmm(rows: DataFrame, columns: Sequence[str], k: int = 3, iterations: int = 100, tolerance: float = 1e-6, by: str = "model_id") -> DataFrame:
    """One model for each ``by``, from the rows marked ``fit``, pooled over its series: one row a model.

    Each model starts from a mixture and is refined until its log likelihood changes by less than ``tolerance`` of
    itself, at most ``iterations`` times. Models are dealt to batches of about MODEL_BATCH, each fitted in one task,
    which holds their rows; nothing passes through the driver but the number of models.
    """
    columns = list(columns)
    fit = rows.where("fit").select(by, "series_id", "date", *columns)
    count = max(fit.select(by).distinct().count(), 1)
    batches = max(-(-count // MODEL_BATCH), min(count, rows.sparkSession.sparkContext.defaultParallelism))
    fields = [c.strip().split(" ")[0] for c in _MODEL.split(",")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        groups = [(model, g.sort_values(["series_id", "date"])) for model, g in own.groupby(by, sort=True)]
        out = []
        for a in range(0, len(groups), MODEL_BATCH):
            part = groups[a : a + MODEL_BATCH]
            longest = max(len(g) for _, g in part)
            x, real, begins = np.zeros((longest, len(part), len(columns))), np.zeros((longest, len(part)), bool), np.ones((longest, len(part)), bool)
            for m, (_, g) in enumerate(part):
                series = g["series_id"].to_numpy()
                x[: len(g), m], real[: len(g), m] = g[columns].to_numpy(float), True
                begins[1 : len(g), m] = series[1:] != series[:-1]
            out += [(model, *fitted) for (model, _), fitted in zip(part, _fitted(x, real, begins, k, iterations, tolerance))]
        return pd.DataFrame(out, columns=[by, *fields])

    schema = f"{by} {rows.schema[by].dataType.simpleString()}, {_MODEL}"
    return fit.withColumn("batch", F.pmod(F.xxhash64(by), F.lit(batches))).groupBy("batch").applyInPandas(run, schema)


def _forward(log_local: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Filtered state probabilities of one series."""
    local = np.exp(log_local - log_local.max(1, keepdims=True))
    out = np.zeros_like(local)
    for t in range(len(local)):
        a = (out[t - 1] @ move if t else start) * local[t]
        out[t] = a / max(a.sum(), 1e-300)
    return out


def hmm_labels(rows: DataFrame, columns: Sequence[str], models: DataFrame, by: str = "model_id", method: str = "filter") -> DataFrame:
    """State probabilities of each row: ``filter`` (past only), ``smooth`` or ``viterbi`` (the whole series); rows meet their model by its key."""
    columns = list(columns)

    def series(own: pd.DataFrame, means: np.ndarray, variances: np.ndarray, start: np.ndarray, move: np.ndarray) -> pd.DataFrame:
        log_local = _local(own[columns].to_numpy(), means, variances)
        prob = _forward(log_local, start, move)
        if method == "smooth":
            local, beta = np.exp(log_local - log_local.max(1, keepdims=True)), np.ones(prob.shape[1])
            for t in range(len(prob) - 1, -1, -1):
                following = move @ (local[t] * beta)
                prob[t] = prob[t] * beta / (prob[t] * beta).sum()
                beta = following / following.sum()
        label = prob.argmax(1)
        if method == "viterbi":
            with np.errstate(divide="ignore"):
                log_move, best = np.log(move), np.log(start) + log_local[0]
            back = np.zeros(log_local.shape, int)
            for t in range(1, len(log_local)):
                step = best[:, None] + log_move
                back[t] = step.argmax(0)
                best = step.max(0) + log_local[t]
            label[-1] = best.argmax()
            for t in range(len(label) - 2, -1, -1):
                label[t] = back[t + 1][label[t + 1]]
        return pd.DataFrame({"series_id": own["series_id"], "date": own["date"], by: own[by], "label": label.astype("int32"), "prob": list(prob)})

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(model):
            return pd.DataFrame(columns=["series_id", "date", by, "label", "prob"])
        m = model.iloc[0]
        k = len(m["start"])
        parts = np.reshape(m["means"], (k, -1)), np.reshape(m["variances"], (k, -1)), np.asarray(m["start"]), np.reshape(m["move"], (k, k))
        return pd.concat([series(g, *parts) for _, g in own.sort_values(["series_id", "date"]).groupby("series_id", sort=True)])

    schema = f"series_id string, date date, {by} {rows.schema[by].dataType.simpleString()}, label int, prob array<double>"
    own = rows.select(by, "series_id", "date", *columns).groupBy(by)
    return own.cogroup(models.groupBy(by)).applyInPandas(run, schema)


def refit_schedule(rows: DataFrame, first: int = 504, every: int = 63) -> DataFrame:
    """Rows replicated for walk-forward refits: refit j fits on rows before first + j * every and labels the next ``every``."""
    pos = F.row_number().over(ordered()) - 1
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = rows.withColumns({"pos": pos, "n": n})
    refits = F.greatest(F.ceil((F.col("n") - first) / every), F.lit(0)).cast("int")
    own = F.greatest(F.floor((F.col("pos") - first) / every), F.lit(0)).cast("int")
    rows = rows.withColumn("refit", F.explode(F.when(refits > own, F.sequence(own, refits - 1)).otherwise(F.array().cast("array<int>"))))
    start = first + F.col("refit") * every
    rows = rows.withColumns({"fit": F.col("pos") < start, "test": (F.col("pos") >= start) & (F.col("pos") < start + every)})
    return rows.withColumn("model_id", F.concat_ws("#", "series_id", "refit"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of jointly labelled days with the same label, a series."""
    joined = a.where(F.col("label") != UNKNOWN).select("series_id", "date", F.col("label").alias("x"))
    joined = joined.join(b.where(F.col("label") != UNKNOWN).select("series_id", "date", F.col("label").alias("y")), ["series_id", "date"])
    return joined.groupBy("series_id").agg(F.count("*").alias("days"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))

"""Nested purged walk-forward of monthly models, with every fit a row of work.

Samples have ``series_id``, ``t0``, ``t1``, ``y`` (0 to k - 1) and ``x``, an array of features. The
training rows of an outer fold are cut into purged inner folds by the same window expressions
(:func:`inner_roles`). A fold's rows are packed into one row, which meets the grid by
``explode``, so all inner and outer folds of all series and all settings are fitted at once by
one job, balanced over the tasks. Boosted settings that differ only in their rounds share a fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import learners, validation
from .learning import log_loss

INNER_FOLDS, EMBARGO = 5, 1
#: Setting = (kind, parameters); of equal losses the earlier one is taken. Fixed values.
LOGISTIC_GRID = [("logistic", {"c": c}) for c in (0.001, 0.01, 0.1, 1.0, 10.0)]
BOOSTED_GRID = [("boosted", {"leaves": a, "least": b, "rounds": c}) for a, b, c in product((3, 7), (5, 15, 30), (25, 50, 200))]

Grid = Sequence[tuple[str, dict[str, float]]]


def inner_roles(outer: DataFrame, folds: int = INNER_FOLDS, embargo: int = EMBARGO, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, fold, inner, t0, t1, role): purged folds of each outer fold's own training rows, and of nothing else."""
    train = outer.where("role = 'train'").select(*keys, F.col("fold").alias("outer"), "t0", "t1")
    inner = validation.purged_kfold(train, folds, embargo, [*keys, "outer"])
    return inner.select(*keys, F.col("outer").alias("fold"), F.col("fold").alias("inner"), "t0", "t1", "role")


def packed(samples: DataFrame, roles: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a fold: its training and test rows as arrays in order of t0; folds without training rows are left out."""
    on = [c for c in ("series_id", "t0") if c in roles.columns]
    rows = samples.select("series_id", "t0", "y", "x").join(roles.select(*by, *[c for c in on if c not in by], "role"), on)
    part = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("t0", "y", "x")))).alias(role)
    return rows.groupBy(*by).agg(part("train"), part("test")).where("size(train) > 0")


def _settings(grid: Grid) -> Column:
    """The grid as an array of fits: settings that differ only in their rounds are one."""
    fits: dict[tuple, list[tuple[int, float]]] = {}
    for i, (kind, params) in enumerate(grid):
        fits.setdefault((kind, *sorted((k, v) for k, v in params.items() if k != "rounds")), []).append((i, params.get("rounds", 0)))
    each = []
    for (kind, *params), members in fits.items():
        members = sorted(members, key=lambda m: m[1])
        pairs = [F.lit(x) for k, v in params for x in (k, float(v))]
        each.append(F.struct(F.lit(kind).alias("kind"), F.create_map(*pairs).alias("params"), F.array(*[F.lit(i) for i, _ in members]).alias("setting"), F.array(*[F.lit(int(r)) for _, r in members]).alias("rounds")))
    return F.array(*each)


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], int)


def _predicted(work: DataFrame, by: Sequence[str], k: int, codes: dict[int, Sequence[float]]) -> DataFrame:
    """(by, setting, t0, y, proba) of the test rows of packed folds with columns kind, params, setting, rounds."""
    names = [*by, "setting", "t0", "y", "proba"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["test"] is None or not len(r["test"]):
                    continue
                x, y = _arrays(r["train"])
                test, true = _arrays(r["test"])
                params = dict(r["params"])
                rounds = [int(n) for n in r["rounds"]]
                model = learners.fit(r["kind"], params | {"rounds": rounds[-1]}, x, y, k, codes)
                if r["kind"] == "boosted" and len(model["seen"]) > 1:
                    found = [learners.floored(p, model["seen"], k) for p in learners.boosted_stages(model, test, rounds)]
                else:
                    found = [learners.probabilities(model, test)] * len(rounds)
                key = [r[c] for c in by]
                for setting, proba in zip(r["setting"], found):
                    out += [(*key, int(setting), s["t0"], int(t), p.tolist()) for s, t, p in zip(r["test"], true, proba)]
            yield pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in by)
    return work.mapInPandas(run, f"{kinds}, setting int, t0 date, y int, proba array<double>")


def _dealt(work: DataFrame, by: Sequence[str]) -> DataFrame:
    """A fit is worth a task of its own as long as there are tasks to spare."""
    return work.repartition(max(4 * work.sparkSession.sparkContext.defaultParallelism, int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, "setting")


def inner_predictions(samples: DataFrame, inner: DataFrame, grid: Grid, k: int, codes: dict[int, Sequence[float]] | None = None) -> DataFrame:
    """Predictions of all settings for the test rows of all inner folds."""
    by = ["series_id", "fold", "inner"]
    work = packed(samples, inner, by).select("*", F.inline(_settings(grid)))
    return _predicted(_dealt(work, by), by, k, codes or {})


def trials(predictions: DataFrame, by: Sequence[str] = ("series_id", "fold")) -> DataFrame:
    """(by, setting, inner_log_loss, inner_accuracy, inner_n, selected): pooled over the inner folds; ties to the earlier setting."""
    hit = (F.array_position("proba", F.array_max("proba")) - 1 == F.col("y")).cast("double")
    scores = predictions.groupBy(*by, "setting").agg(
        F.avg(log_loss("proba", F.col("y") + 1)).alias("inner_log_loss"), F.avg(hit).alias("inner_accuracy"), F.count("*").alias("inner_n")
    )
    best = F.row_number().over(Window.partitionBy(*by).orderBy("inner_log_loss", "setting"))
    return scores.withColumn("selected", best == 1)


def _chosen(selected: DataFrame, grid: Grid) -> DataFrame:
    """The selected setting of each fold with its kind and parameters."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.create_map(*[F.lit(x) for p in sorted(params) for x in (p, float(params[p]))]).alias("params")) for i, (kind, params) in enumerate(grid)])
    rows = selected.where("selected").withColumn("s", F.element_at(each, F.col("setting") + 1))
    return rows.select("series_id", "fold", F.col("s.kind").alias("kind"), F.col("s.params").alias("params"), F.array("setting").alias("setting"), F.array(F.coalesce(F.try_element_at("s.params", F.lit("rounds")), F.lit(0.0)).cast("int")).alias("rounds"))


def nested_walk_forward(
    samples: DataFrame, outer: DataFrame, grid: Grid, k: int, codes: dict[int, Sequence[float]] | None = None, folds: int = INNER_FOLDS, embargo: int = EMBARGO
) -> tuple[DataFrame, DataFrame]:
    """(predictions, trials): each outer fold tuned on inner folds of its training rows, refitted on them all, and tested."""
    tried = trials(inner_predictions(samples, inner_roles(outer, folds, embargo), grid, k, codes))
    by = ["series_id", "fold"]
    work = packed(samples, outer, by).join(_chosen(tried, grid), by)
    return _predicted(_dealt(work, by), by, k, codes or {}), tried


def tuned_models(
    samples: DataFrame, grid: Grid, k: int, columns: Sequence[str], codes: dict[int, Sequence[float]] | None = None, folds: int = INNER_FOLDS, embargo: int = EMBARGO
) -> DataFrame:
    """A model for serving of each series, tuned on purged folds of all its samples and fitted on them: (series_id, kind, params, n_train, train_first, train_last, label_end, artifact)."""
    every = samples.select("series_id", F.lit(0).alias("fold"), "t0", "t1", F.lit("train").alias("role"))
    chosen = _chosen(trials(inner_predictions(samples, inner_roles(every, folds, embargo), grid, k, codes)), grid)
    work = packed(samples, every, ["series_id", "fold"]).join(chosen, ["series_id", "fold"])
    codes, columns = codes or {}, list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            models = [learners.fit(r["kind"], dict(r["params"]), *_arrays(r["train"]), k, codes) for r in batch.to_dict("records")]
            yield pd.DataFrame({"series_id": batch["series_id"], "artifact": [learners.artifact(m, columns) for m in models]})

    artifacts = _dealt(work, ["series_id"]).mapInPandas(run, "series_id string, artifact string")
    spans = samples.groupBy("series_id").agg(F.count("*").alias("n_train"), F.min("t0").alias("train_first"), F.max("t0").alias("train_last"), F.max("t1").alias("label_end"))
    return artifacts.join(chosen.select("series_id", "kind", "params"), "series_id").join(spans, "series_id")


def scored(models: DataFrame, inputs: DataFrame) -> DataFrame:
    """(series_id, version, as_of, x, ..., proba, prediction): stored models (series_id, version, artifact) applied to rows (series_id, as_of, x)."""
    rows = inputs.join(models.select("series_id", "version", "artifact"), "series_id")
    names = [c for c in rows.columns if c != "artifact"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = {text: learners.loaded(text) for text in batch["artifact"].unique()}
            proba = [learners.probabilities(model[t], np.array([x], float))[0] for t, x in zip(batch["artifact"], batch["x"])]
            yield batch[names].assign(proba=[p.tolist() for p in proba], prediction=[int(p.argmax()) for p in proba])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInPandas(run, f"{schema}, proba array<double>, prediction int")

"""Strategies that learn the next day's direction, and the catalog with them.

A series is one fit: its rows up to the cutoff, less the one whose label reaches past it, train a
model; from the cutoff on, the position is what the model says, and before it the strategy is flat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import ordered

from . import learners, signals
from .indicators import daily_features, next_day_label
from .validation import numbered, split_position

#: Parameters of each kind of model. Fixed values.
KINDS = {"logistic": {"c": 1.0}, "boosted": {"leaves": 7, "least": 30, "rounds": 50}}
MODES = ("feature", "conditional")
LEAST_ROWS = 150


def direction_rows(bars: DataFrame, train_share: float = 0.7, labels: DataFrame | None = None) -> DataFrame:
    """(series_id, date, role, x, y, label): daily features with the next day's direction.

    ``role`` is train up to the row whose label ends before the cutoff, and test from the cutoff on; rows with a
    missing feature, and training rows without a label, are left out. ``label`` is -1 without ``labels``.
    """
    features = daily_features(bars)
    columns = [c for c in features.columns if c not in ("series_id", "date")]
    rows = features.join(next_day_label(bars), ["series_id", "date"])
    rows = numbered(rows, ["series_id"]).withColumn("next", F.lead("date").over(ordered()))
    cut = F.min(F.when(F.col("pos") == split_position(F.col("n"), train_share), F.col("date"))).over(Window.partitionBy("series_id"))
    rows = rows.withColumn("cut", cut).dropna(subset=columns)
    role = F.when(F.col("date") >= F.col("cut"), "test").when((F.col("next") < F.col("cut")) & F.col("y").isNotNull(), "train")
    rows = rows.select("series_id", "date", role.alias("role"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col("y").cast("int").alias("y"))
    rows = rows.where("role is not null")
    if labels is None:
        return rows.withColumn("label", F.lit(-1))
    rows = rows.join(labels.select("series_id", "date", "label"), ["series_id", "date"], "left")
    return rows.withColumn("label", F.coalesce("label", F.lit(-1)))


def direction_predictions(rows: DataFrame, kind: str = "logistic", mode: str = "feature", least: int = LEAST_ROWS) -> DataFrame:
    """(series_id, date, p_up) of the test rows; a series without training rows has none.

    ``feature`` gives one model the label as codes (none for -1); ``conditional`` fits one for each label with ``least``
    training rows of both directions, and takes the model of all rows elsewhere.
    """
    if kind not in KINDS or mode not in MODES:
        raise ValueError(f"kind must be one of {list(KINDS)}, mode one of {list(MODES)}")

    def series(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        train, test = own[own["role"] == "train"], own[own["role"] == "test"]
        if not len(train) or not len(test):
            return pd.DataFrame(columns=["series_id", "date", "p_up"])
        x, z = np.array(train["x"].to_list(), float), np.array(test["x"].to_list(), float)
        y, at, to = train["y"].to_numpy(int), train["label"].to_numpy(int), test["label"].to_numpy(int)
        if mode == "feature":
            codes = [float(c) for c in np.unique(at) if c >= 0]
            if codes and kind == "logistic":
                x, z = np.column_stack([x, at]), np.column_stack([z, to])
                model = learners.fit(kind, KINDS[kind], x, y, 2, {x.shape[1] - 1: codes})
            else:
                x, z = (np.column_stack([v, w]) if codes else v for v, w in ((x, at), (z, to)))
                model = learners.fit(kind, KINDS[kind], x, y, 2, {})
            p = learners.probabilities(model, z)[:, 1]
        else:
            p = learners.probabilities(learners.fit(kind, KINDS[kind], x, y, 2, {}), z)[:, 1]
            for c in np.unique(at[at >= 0]).tolist():
                mine = at == c
                if mine.sum() >= least and len(np.unique(y[mine])) == 2 and (to == c).any():
                    p[to == c] = learners.probabilities(learners.fit(kind, KINDS[kind], x[mine], y[mine], 2, {}), z[to == c])[:, 1]
        return pd.DataFrame({"series_id": test["series_id"], "date": test["date"], "p_up": p})

    return rows.groupBy("series_id").applyInPandas(series, "series_id string, date date, p_up double")


def ml_direction(
    bars: DataFrame, train_share: float = 0.7, kind: str = "logistic", labels: DataFrame | None = None, mode: str = "feature", least: int = LEAST_ROWS
) -> DataFrame:
    """1 on days from the cutoff on for which a rise is likelier, else 0. ``labels`` must be causal, or fitted before the cutoff."""
    up = direction_predictions(direction_rows(bars, train_share, labels), kind, mode, least)
    rows = bars.select("series_id", "date").join(up, ["series_id", "date"], "left")
    return rows.select("series_id", "date", F.coalesce((F.col("p_up") > 0.5).cast("double"), F.lit(0.0)).alias("signal"))


def refit_share(train: int, test: int) -> float:
    """The ``train_share`` with which a strategy built on a fold of ``train`` and ``test`` rows learns from the first ones alone."""
    return train / (train + test)


#: The strategies of :data:`.signals.CATALOG` and those that learn.
CATALOG = signals.CATALOG | {
    s.name: s
    for s in (
        signals.SignalSpec("ml_direction", 1, ml_direction, {"train_share": (0.3, 0.95)}),
        signals.SignalSpec("ml_direction_boosted", 1, lambda bars, train_share=0.7: ml_direction(bars, train_share, "boosted"), {"train_share": (0.3, 0.95)}),
    )
}

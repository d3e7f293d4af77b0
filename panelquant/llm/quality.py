"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams: runs of four bytes, and runs of one
to four token shapes (letter case, digits, edge punctuation, length, and whether
the token repeats one of the tokens before it). Each indicator is scaled by its
class log-count ratio, and a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent. The fit uses a bounded sample of labelled
rows; scoring reads every text once and shuffles nothing.

Cases: a null or empty text has no n-grams and gets the score of the bias alone;
without labelled rows, or with one class only, every score is that class's (0.5
without any); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .labelled import held_out, labelled_sample

BYTE_GRAMS, SHAPE_GRAMS = 1 << 17, 1 << 15
DIMENSIONS = BYTE_GRAMS + SHAPE_GRAMS
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 6000
COST, SMOOTHING, EPOCHS = 10.0, 1.0, 20

#: Cells of the indicator table that are held at once.
_CELLS = 1 << 26


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, first): a small number for each token that says what it looks like, not which it is."""
    starts, ends, first = T.spans(data, offsets, T.BLANK)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    value = T.hashes(data, starts, ends)
    row = T.row_of(first)
    kind = np.full(256, 4, np.int64)  # 0 lower, 1 upper, 2 digit, 3 other punctuation, 4 non-ASCII
    kind[:128] = 3
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    upper = np.concatenate([[0], np.cumsum(kind[data] == 1)])
    signs = np.concatenate([[0], np.cumsum(kind[data] == 3)])
    size = ends - starts
    capitals, punctuation = upper[ends] - upper[starts], signs[ends] - signs[starts]
    shape = kind[data[starts]] + 5 * kind[data[ends - 1]]
    shape = shape * 3 + np.minimum(capitals, 1) + (2 * capitals > size)
    shape = shape * 4 + np.minimum(punctuation, 3)
    shape = shape * 4 + np.digitize(size, (2, 6, 15))
    again = np.zeros(len(value), np.int64)
    for back, code in ((1, 1), (2, 2)):
        same = (value[back:] == value[:-back]) & (row[back:] == row[:-back])
        again[back:] = np.where(same & (again[back:] == 0), code, again[back:])
    return (shape * 3 + again).astype(np.uint64), first


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct hashed n-grams of each text, in order."""
    data, offsets = T.utf8(texts)
    rows, found = [], []
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 4:
        gram = data[:-3].astype(np.uint64)
        for k in range(1, 4):
            gram = gram << np.uint64(8) | data[k : len(data) - 3 + k]
        inside = row[3:] == row[:-3]
        rows.append(row[:-3][inside])
        found.append((T.mix(gram[inside] * T._ODD) % np.uint64(BYTE_GRAMS)).astype(np.int64))
    shape, first = _shapes(data, offsets)
    shape_row = T.row_of(first)
    for size in range(1, 5):
        if len(shape) < size:
            break
        whole = len(shape) - size + 1
        acc = np.full(whole, size, np.uint64)
        for k in range(size):
            acc = T.mix(acc * T._ODD + shape[k : k + whole])
        inside = shape_row[size - 1 :] == shape_row[:whole]
        rows.append(shape_row[:whole][inside])
        found.append(BYTE_GRAMS + (acc[inside] % np.uint64(SHAPE_GRAMS)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, found = np.concatenate(rows), np.concatenate(found)
    step, out = max(1, _CELLS // DIMENSIONS), []
    order = np.argsort(rows, kind="stable")
    rows, found = rows[order], found[order]
    for start in range(0, n, step):
        a, b = np.searchsorted(rows, [start, start + step])
        if a == b:
            continue
        seen = np.zeros(min(step, n - start) * DIMENSIONS, bool)
        seen[(rows[a:b] - start) * DIMENSIONS + found[a:b]] = True
        out.append(np.flatnonzero(seen) + start * DIMENSIONS)
    cell = np.concatenate(out) if out else np.zeros(0, np.int64)
    return cell // DIMENSIONS, cell % DIMENSIONS


@dataclass
class Model:
    """Weights and log-count ratios of the n-grams, and the bias; without n-grams if there was nothing to fit."""

    weights: np.ndarray | None
    ratio: np.ndarray | None
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Each text's scaled indicators, at unit length as in the fit, against the weights."""
        n = len(texts)
        if self.weights is None:
            return np.full(n, self.bias)
        row, feature = features(texts)
        ratio = self.ratio[feature]
        length = np.sqrt(np.bincount(row, ratio * ratio, n))
        return np.bincount(row, self.weights[feature] * ratio, n) / np.maximum(length, 1.0) + self.bias


def fit(feature_sets: list[np.ndarray], labels: np.ndarray, cost: float = COST, smoothing: float = SMOOTHING, epochs: int = EPOCHS) -> Model:
    """Log-count ratios, then dual coordinate descent for the L2-regularised hinge loss, which is linear beyond the margin.

    A row's dual variable lies between 0 and ``cost`` times its class's balance; the bias is a weight of a constant 1.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(None, None, 5.0 * y[0] if len(y) else 0.0)
    counts = {s: np.full(DIMENSIONS, smoothing) for s in (1.0, -1.0)}
    for own, s in zip(feature_sets, y):
        counts[s][own] += 1
    ratio = np.log((counts[1.0] / (y > 0).sum()) / (counts[-1.0] / (y < 0).sum()))
    scale = [ratio[own] / max(1.0, np.linalg.norm(ratio[own])) for own in feature_sets]
    weights, bias = np.zeros(DIMENSIONS), 0.0
    alpha, rng = np.zeros(len(y)), np.random.default_rng(7)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    most = cost * balance
    size = np.array([x @ x for x in scale]) + 1
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            own, x = feature_sets[i], scale[i]
            gradient = y[i] * (weights[own] @ x + bias) - 1
            new = min(max(0.0, alpha[i] - gradient / size[i]), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[own] += step * x
                bias += step
                alpha[i] = new
    return Model(weights, ratio, bias)


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col: str, id_col="doc_id", text_col="text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows for which ``where`` (on ``id``) holds.

    Their n-grams go to one task, and the model alone to the driver, whose memory is the smallest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            row, feature = features(batch.column("text"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.record_batch([batch.column("id"), batch.column("label"), sets], ["id", "label", "features"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, where, sample_rows)
    def fitted(rows: pa.Table) -> pa.Table:
        ids, labels = rows.column("id").to_pylist(), rows.column("label").to_numpy()
        sets = [x.as_buffer() for x in rows.column("features")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], bytes(sets[i])))
        model = fit([np.frombuffer(sets[i], "<i4") for i in order], labels[order])
        parts = [None if x is None else x.astype("<f8").tobytes() for x in (model.weights, model.ratio)]
        return pa.table({"weights": pa.array(parts[:1], pa.binary()), "ratio": pa.array(parts[1:], pa.binary()), "bias": pa.array([float(model.bias)])})

    rows = sample.select("id", "label", "text").mapInArrow(run, "id bigint, label int, features binary")
    found = rows.groupBy().applyInArrow(fitted, "weights binary, ratio binary, bias double").collect()
    if not found:
        return fit([], np.zeros(0))
    weights, ratio, bias = found[0]
    return Model(None if weights is None else np.frombuffer(weights, "<f8"), None if ratio is None else np.frombuffer(ratio, "<f8"), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(2 * model.margins(batch.column("text")), -50, 50)))
            yield pa.record_batch([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id bigint, score double, predicted int").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.blocks(batches, text_col):
            yield batch.filter(pa.array(model.margins(batch.column(text_col)) >= 0))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): labels of the fold aren't learned."""
    model = train(docs, labels, ~held_out(F.col("id"), folds, fold), label_col, id_col, text_col)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", "predicted")

"""Two small classifiers for samples of a few hundred rows: penalised logistic regression and boosted trees.

A fit is one row of work of :mod:`.tuning`; models are plain dictionaries of numbers, so
that an artifact is their canonical JSON text and loading one runs no code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np

FORMAT = "panelquant-model/1"
#: Least probability of a class, and what all boosted models share.
FLOOR, RATE, L2, LEAST_HESSIAN = 1e-4, 0.05, 1.0, 1e-3


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _encoded(x: np.ndarray, model: dict) -> np.ndarray:
    """Standardised numbers, a column for each code of a categorical feature (none for unknown codes), and ones."""
    parts = [(x[:, model["numeric"]] - np.array(model["mean"])) / np.array(model["scale"])]
    parts += [(x[:, int(c)][:, None] == np.array(codes)).astype(float) for c, codes in model["codes"].items()]
    return np.concatenate([*parts, np.ones((len(x), 1))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, k: int, c: float, codes: dict[int, Sequence[float]]) -> dict:
    """Newton steps on C * log loss + half the squared weights; the intercept is free. ``y`` holds 0 to k - 1, each at least once."""
    numeric = [j for j in range(x.shape[1]) if j not in codes]
    spread = x[:, numeric].std(0)
    model = {"numeric": numeric, "mean": x[:, numeric].mean(0).tolist(), "scale": np.where(spread > 0, spread, 1.0).tolist(), "codes": {str(j): list(v) for j, v in codes.items()}}
    z = _encoded(x, model)
    d, free = z.shape[1], 1 if k == 2 else k
    target = (y[:, None] == (np.array([1]) if k == 2 else np.arange(k))).astype(float)
    penalty = np.tile(np.append(np.ones(d - 1), 0.0), free)
    w = np.zeros((free, d))

    def probability(w: np.ndarray) -> np.ndarray:
        return _softmax(np.column_stack([np.zeros(len(z)), z @ w[0]]))[:, 1:] if k == 2 else _softmax(z @ w.T)

    def objective(w: np.ndarray) -> float:
        p = probability(w)
        hit = (p * target).sum(1) + ((1 - p[:, 0]) * (1 - target[:, 0]) if k == 2 else 0.0)
        return -c * np.log(np.maximum(hit, 1e-300)).sum() + 0.5 * (penalty * w.ravel() ** 2).sum()

    now = objective(w)
    for _ in range(100):
        p = probability(w)
        slope = c * ((p - target).T @ z).ravel() + penalty * w.ravel()
        if np.abs(slope).max() < 1e-9 * max(1.0, c * len(z)):
            break
        curve = np.zeros((free * d, free * d))
        for i in range(free):
            for j in range(i, free):
                block = c * (z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
                curve[i * d : (i + 1) * d, j * d : (j + 1) * d] = block
                curve[j * d : (j + 1) * d, i * d : (i + 1) * d] = block.T
        curve[np.diag_indices_from(curve)] += penalty + 1e-9
        step, share = np.linalg.solve(curve, slope).reshape(free, d), 1.0
        while (then := objective(w - share * step)) > now and share > 1e-6:
            share /= 2
        if then >= now:
            break
        w, now = w - share * step, then
    return model | {"weights": w.tolist()}


class _Grower:
    """Trees grown leaf by leaf on one sample, the leaf with the largest gain first."""

    def __init__(self, x: np.ndarray, leaves: int, least: int):
        self.x, self.leaves, self.least = x, leaves, least
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()

    def _split(self, inside: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple | None:
        """(gain, feature, threshold) of a leaf's best split; of equal gains the first feature and lowest threshold."""
        n = int(inside.sum())
        if n < 2 * self.least:
            return None
        rows = self.order[inside[self.order]].reshape(len(self.order), n)
        value = np.take_along_axis(self.x.T, rows, 1)
        left_g, left_h = g[rows].cumsum(1)[:, :-1], h[rows].cumsum(1)[:, :-1]
        total_g, total_h = g[inside].sum(), h[inside].sum()
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - total_g**2 / (total_h + L2)
        size = np.arange(1, n)
        fine = (value[:, 1:] > value[:, :-1]) & (size >= self.least) & (n - size >= self.least) & (left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN)
        gain = np.where(fine, gain, -np.inf)
        f, at = np.unravel_index(int(gain.argmax()), gain.shape)
        return (float(gain[f, at]), int(f), float((value[f, at] + value[f, at + 1]) / 2)) if gain[f, at] > 1e-12 else None

    def grow(self, g: np.ndarray, h: np.ndarray) -> list:
        """A tree as nodes [feature, threshold, left, right] and leaves [value]."""
        nodes: list[list] = [[0.0]]
        inside = {0: np.ones(len(self.x), bool)}
        best = {0: self._split(inside[0], g, h)}
        while len(inside) < self.leaves and any(best.values()):
            at = max((k for k in best if best[k]), key=lambda k: (best[k][0], -k))
            _, f, threshold = best.pop(at)
            rows = inside.pop(at)
            low = rows & (self.x[:, f] <= threshold)
            nodes[at] = [f, threshold, len(nodes), len(nodes) + 1]
            for part in (low, rows & ~low):
                inside[len(nodes)] = part
                best[len(nodes)] = self._split(part, g, h)
                nodes.append([0.0])
        for at, rows in inside.items():
            nodes[at] = [float(-RATE * g[rows].sum() / (h[rows].sum() + L2))]
        return nodes


def _tree_values(nodes: list, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    for k, node in enumerate(nodes):  # children come after their parent
        if len(node) > 1:
            here = at == k
            at[here] = np.where(x[here, node[0]] <= node[1], node[2], node[3])
    return np.array([n[0] if len(n) == 1 else 0.0 for n in nodes])[at]


def _boosted_probability(score: np.ndarray) -> np.ndarray:
    return _softmax(np.column_stack([np.zeros(len(score)), score[:, 0]])) if score.shape[1] == 1 else _softmax(score)


def fit_boosted(x: np.ndarray, y: np.ndarray, k: int, leaves: int, least: int, rounds: int) -> dict:
    """Gradient boosting from the class shares; two classes share one tree a round, more have one each."""
    share = np.bincount(y, minlength=k) / len(y)
    free = 1 if k == 2 else k
    start = np.log(share[1:] / share[:1]) if k == 2 else np.log(share)
    target = (y[:, None] == (np.array([1]) if k == 2 else np.arange(k))).astype(float)
    factor = 1.0 if k == 2 else k / (k - 1)
    score, grower, trees = np.tile(start, (len(x), 1)), _Grower(x, leaves, least), []
    for _ in range(rounds):
        p = _boosted_probability(score)[:, -free:]
        own = [grower.grow(p[:, j] - target[:, j], factor * p[:, j] * (1 - p[:, j])) for j in range(free)]
        score = score + np.column_stack([_tree_values(t, x) for t in own])
        trees.append(own)
    return {"start": start.tolist(), "trees": trees}


def boosted_stages(model: dict, x: np.ndarray, stages: Sequence[int]) -> Iterator[np.ndarray]:
    """Probabilities after so many rounds, for rising numbers of rounds."""
    score, done = np.tile(np.array(model["start"]), (len(x), 1)), 0
    for stage in stages:
        for trees in model["trees"][done:stage]:
            score = score + np.column_stack([_tree_values(t, x) for t in trees])
        done = stage
        yield _boosted_probability(score)


def floored(p: np.ndarray, seen: Sequence[int], k: int) -> np.ndarray:
    """Probabilities of all classes from those that were seen in training, at least FLOOR, adding up to 1 again."""
    out = np.zeros((len(p), k))
    out[:, list(seen)] = p
    out = np.maximum(out, FLOOR)
    return out / out.sum(1, keepdims=True)


def fit(kind: str, params: dict[str, float], x: np.ndarray, y: np.ndarray, k: int, codes: dict[int, Sequence[float]]) -> dict:
    """A model of classes 0 to k - 1; one class alone is predicted as it is."""
    seen = np.unique(y)
    own = np.searchsorted(seen, y)
    body: dict = {}
    if len(seen) > 1 and kind == "logistic":
        body = fit_logistic(x, own, len(seen), params["c"], codes)
    elif len(seen) > 1:
        body = fit_boosted(x, own, len(seen), int(params["leaves"]), int(params["least"]), int(params["rounds"]))
    return {"format": FORMAT, "kind": kind, "classes": k, "seen": seen.tolist(), **body}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if len(model["seen"]) == 1:
        p = np.ones((len(x), 1))
    elif model["kind"] == "logistic":
        w, z = np.array(model["weights"]), _encoded(x, model)
        p = _boosted_probability(z @ w.T)
    else:
        (p,) = boosted_stages(model, x, [len(model["trees"])])
    return floored(p, model["seen"], model["classes"])


def artifact(model: dict, columns: Sequence[str]) -> str:
    """Canonical text: the same fit gives the same text, and the text the same predictions."""
    return json.dumps(model | {"columns": list(columns)}, sort_keys=True, separators=(",", ":"), allow_nan=False)


def loaded(text: str) -> dict:
    model = json.loads(text)
    if model.get("format") != FORMAT:
        raise ValueError(f"unknown model format {model.get('format')!r}")
    return model

"""Quality rules learned as gradient-boosted trees over document statistics.

Trees grow on binned features with second-order gains. On chosen features they only split so that the
outcome never rises (-1) or never falls (+1) with the feature. The finished trees are flat numpy node arrays,
and all rows of a batch walk them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lavra.llm.statistics import FEATURES

SAMPLE_ROWS = 20_000  # labelled rows used for training
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 60, 4, 64, 0.15, 1.0, 5.0
# More symbols, repeated lines or repeated words never raise the score; more distinct words never lower it.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "adjacent": -1, "distinct": 1}


@dataclass
class Trees:
    """Nodes of all trees: feature (-1 at a leaf), threshold, left and right node, leaf value; roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                feature = self.feature[node]
                at = x[rows, np.maximum(feature, 0)]
                below = np.where(at <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(feature < 0, node, below)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def _best_split(grad, hess, signs, low, high):
    """Best (gain, feature, bin, left value, right value) from per-bin sums, or None."""
    gl, hl = np.cumsum(grad, axis=1)[:, :-1], np.cumsum(hess, axis=1)[:, :-1]
    g, h = grad[0].sum(), hess[0].sum()
    gr, hr = g - gl, h - hl
    left = np.clip(-gl / (hl + RIDGE), low, high)
    right = np.clip(-gr / (hr + RIDGE), low, high)

    def worth(value, g, h):
        return -(g * value + 0.5 * (h + RIDGE) * value**2)

    gain = worth(left, gl, hl) + worth(right, gr, hr) - worth(np.clip(-g / (h + RIDGE), low, high), g, h)
    bad = (hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | (signs[:, None] * (right - left) < 0)
    gain = np.where(bad, -np.inf, gain)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= 1e-6:
        return None
    return f, b, left[f, b], right[f, b]


def train(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] = MONOTONE, names=FEATURES) -> Trees:
    d = x.shape[1]
    signs = np.array([monotone.get(n, 0) for n in names])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
    cells = binned + np.arange(d) * BINS
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    nodes, roots = [], []

    def grow(rows, depth, low, high, grad, hess):
        at = len(nodes)
        nodes.append(None)
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + RIDGE), low, high))
        split = None
        if depth < DEPTH and len(rows) > 1:
            flat = cells[rows].ravel()
            sums = [np.bincount(flat, weights=np.repeat(v[rows], d), minlength=d * BINS).reshape(d, BINS) for v in (grad, hess)]
            split = _best_split(*sums, signs, low, high)
        if split is None:
            nodes[at] = (-1, 0.0, at, at, RATE * value)
            raw[rows] += RATE * value
            return at
        f, b, left, right = split
        middle = (left + right) / 2
        # Values under a constrained split stay on their side of its middle.
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
        goes = binned[rows, f] <= b
        threshold = float(edges[f][b]) if b < len(edges[f]) else np.inf
        children = [grow(rows[m], depth + 1, *lim, grad, hess) for m, lim in zip((goes, ~goes), bounds)]
        nodes[at] = (int(f), threshold, *children, 0.0)
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(feature, threshold, left, right, value, np.array(roots), base)


def fit(rows: DataFrame, *, key="doc_id", label="quality", features="features", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Trees | None:
    """Train on at most ``sample_rows`` labelled rows, chosen by a hash of the key; None without both labels."""
    labelled = rows.where(F.col(label).isin(0, 1))
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(draw < sample_rows / max(n, 1)) if n > sample_rows else labelled
    if n > sample_rows and (many := chosen.count()) > 2 * sample_rows:  # keys repeat
        chosen = chosen.where(F.rand(seed) < sample_rows / many)
    table = chosen.select(F.col(label).cast("int").alias("y"), F.col(features).alias("x")).toArrow()
    y = table["y"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y))
    return train(x[order], y[order])


def scored(model: Trees | None, features) -> Column:
    """Probability of label 1; 1 everywhere if there is no model, so that nothing is dropped unlearned."""
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return run(F.col(features))

"""Text quality by a regularised quadratic discriminant over document statistics.

Class means and covariances come from sums that Spark adds up over all labelled rows. Each covariance is
shrunk towards the pooled one and its diagonal, factored once, and the score is the calibrated difference
of the two log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lavra.llm.statistics import FEATURES

SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.1
BINS = 2048


@dataclass
class Discriminant:
    """Centres and inverse Cholesky factors of the two classes; ``slope`` and ``shift`` calibrate."""

    means: np.ndarray
    whiten: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_dets):
            density.append(-0.5 * (((x - mean) @ whiten.T) ** 2).sum(axis=1) - log_det)
        return density[1] - density[0]

    def squeezed(self, x: np.ndarray) -> np.ndarray:
        """The log ratio on a scale of -1 to 1, for the calibration's histogram."""
        return np.arcsinh(self.log_ratio(x)) / np.arcsinh(1e9)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.arcsinh(self.log_ratio(x)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(batches):
    """Per label: the entries of sum, outer product sum and count, as (label, place, value)."""
    d = len(FEATURES)
    totals = {}
    for batch in batches:
        labels, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        for label in np.unique(labels):
            own = np.column_stack((np.ones((labels == label).sum()), x[labels == label]))
            totals[label] = totals.get(label, np.zeros((d + 1, d + 1))) + own.T @ own
    for label, total in totals.items():
        n = total.size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, label), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(total.ravel())], names=["label", "place", "value"]
        )


def _binned(model: Discriminant):
    @F.arrow_udf("int")
    def run(rows: pa.Array) -> pa.Array:
        squeezed = model.squeezed(_matrix(rows))
        return pa.array(np.clip((squeezed + 1) / 2 * BINS, 0, BINS - 1).astype(np.int32))

    return run


def _logistic(z: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve on weighted points, by Newton steps with a small ridge."""
    w = np.zeros(2)
    x = np.column_stack((z, np.ones_like(z)))
    n = good + bad
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - n * p) - 1e-3 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def fit(rows: DataFrame, *, label="quality", features="features") -> Discriminant | None:
    """Learn from all rows with label 0 or 1; None unless both occur. Only sums reach the driver."""
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.col(features).alias("x"))
    sums = rows.mapInArrow(_moments, "label int, place int, value double")
    d = len(FEATURES)
    total = np.zeros((2, (d + 1) ** 2))
    for label_, place, value in sums.groupBy("label", "place").agg(F.sum("value")).collect():
        total[label_, place] = value
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    if not n.all():
        return None
    means = total[:, 0, 1:] / n[:, None]
    own = np.array([total[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in range(2)])
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiten, log_dets = [], []
    for k in range(2):
        cov = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * own[k] + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * floor
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        log_dets.append(np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.array(whiten), np.array(log_dets))
    table = np.zeros((2, BINS))
    for label_, place, count in rows.groupBy("label", _binned(model)("x").alias("bin")).count().collect():
        table[label_, place] = count
    centres = ((np.arange(BINS) + 0.5) / BINS * 2 - 1) * np.arcsinh(1e9)
    model.slope, model.shift = _logistic(centres, table[1], table[0])
    return model


def scored(model: Discriminant | None, features) -> Column:
    """Probability of label 1, from 0 to 1; 0.5 everywhere if there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)))

    return run(F.col(features))

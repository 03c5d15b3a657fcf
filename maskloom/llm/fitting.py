"""Small fits made on the driver from bounded or summed inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, limit: int) -> DataFrame:
    """Training rows: documents that have a label and whose fold is not 0, at most about ``limit`` of them.

    The rows are chosen by a hash of their id alone, so a document stays or goes the same way wherever it is
    stored.  A document with several labels takes their mean, rounded; null labels and ids don't count.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (common.fold("doc_id", folds) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(F.col(label).cast("double"))).cast("double").alias("y"))
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * limit / total))
    return docs.join(known, "doc_id")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: block centres and values, to be interpolated."""
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, c = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] += c
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], np.clip((b[:, 0] + 0.5) / (b[:, 1] + 1), 0, 1)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Weights of a logistic fit with a Gaussian prior around ``prior``, by damped Newton steps."""
    w = prior.astype(float).copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w

"""Small linear models for the driver: bounded samples in, weights out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick


def labelled_sample(docs: DataFrame, labels: DataFrame, names: list[str], most: int, where=None) -> DataFrame:
    """doc_id, text and the labels of at most ``most`` labelled documents.

    The ones with the smallest hash of their id are taken: an even sample, the
    same in each run. Labels of one document that disagree or repeat are
    averaged and rounded up; null labels and labels without a document don't count. The
    sample's ids are at most ``most`` rows and so are broadcast.
    """
    rows = pick(labels, doc_id="long", **dict.fromkeys(names, "double")).dropna()
    if where is not None:
        rows = rows.filter(where)
    rows = rows.groupBy("doc_id").agg(*[F.ceil(F.avg(n) - 0.5 + 1e-9).cast("int").alias(n) for n in names])
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to zero."""
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 100, rate: float = 0.15) -> np.ndarray:
    """Weights, the last one the intercept (not penalised)."""
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])

    def gradient(w):
        g = x1.T @ (sigmoid(x1 @ w) - y).astype(x.dtype) / max(1, len(y))
        g[:-1] += penalty * w[:-1]
        return g

    return descend(gradient, np.zeros(x1.shape[1], dtype=x.dtype), steps, rate)

"""Small logistic regressions on the driver, and bounded samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Rows of (feature, value) entries."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(i) for i, _ in rows])
        self.col = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], dims)


def fit(x: Sparse, y: np.ndarray, dims: int, l2: float, steps: int = 150, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a class-balanced, L2-penalised logistic regression (Adam, full batches)."""
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(dims), 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        r = c * (sigmoid(x.dot(w) + b) - y)
        g = np.r_[x.back(r, dims) + l2 * w, r.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift: P(1 | z) = sigmoid(scale * z + shift), with his smoothed labels."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    unit = max(1e-9, float(z.std()))
    x = np.c_[z / unit, np.ones(len(z))]

    def loss(q):
        m = x @ q
        return (np.logaddexp(0, m) - t * m).sum() + 1e-3 * q[0] ** 2
    q = np.array([1.0, 0.0])
    for _ in range(100):                                   # Newton's method, steps halved until the loss falls
        p = sigmoid(x @ q)
        g = x.T @ (p - t) + np.array([2e-3 * q[0], 0.0])
        d = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + np.diag([2e-3, 1e-6]), g)
        while loss(q - d) > loss(q) and abs(d).max() > 1e-10:
            d = d / 2
        q = q - d
        if abs(d).max() < 1e-9:
            break
    return float(q[0] / unit), float(q[1])


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where=None) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` labelled documents of each class.

    The ids are chosen from the label table alone, in the order of a hash, so
    that the sample is bounded and the same in every run; at most
    ``2 * per_class`` ids are then broadcast.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    if where is not None:
        ids = ids.where(where(F.col("doc_id")))
    ids = ids.dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id"))
    some = ids.where("y = 0").orderBy("h", "doc_id").limit(per_class).unionByName(ids.where("y = 1").orderBy("h", "doc_id").limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "y")), "doc_id").limit(4 * per_class)

"""Labelled samples and a small logistic fit, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, at most.
PER_CLASS = 3000


def held_out(mod: int, rest: int):
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest`` (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_class: int = PER_CLASS) -> DataFrame:
    """text, y of at most ``per_class`` documents of each class, none of them held out.

    Which documents: those least by a hash of the id, so that the choice depends on no order.
    Of rows that share a ``doc_id`` the least text counts; labels without an id are left out.
    """
    y = labels.filter(~held_out(mod, rest) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    picks = [y.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    picks = picks[0].unionByName(picks[1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picks), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the bias last) of a ridge logistic regression with balanced classes, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, max((y == 1).mean(), 1e-9), max((y == 0).mean(), 1e-9))
    weight, w = 0.5 / share / len(y), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge / len(y) * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge / len(y) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

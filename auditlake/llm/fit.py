"""Bounded samples of labelled rows for fitting, and one-variable calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, n: int) -> Column:
    """CRC-32 of an id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def sampled(labels: DataFrame, y: str, per_class: int, salt: int = 1) -> DataFrame:
    """doc_id, y and `part` (0 or 1) of about per_class rows of each class at most, chosen by a hash of doc_id.

    Classes are counted over all rows; the fraction kept of each follows from its count, so the sample is bounded
    whatever the input. Rows with null doc_id or y are left out; of several labels of a document the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(y).isNotNull()).groupBy("doc_id").agg(F.max(y).alias(y))
    counts = {r[y]: r["n"] for r in known.groupBy(y).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.select("doc_id", y, F.lit(0).alias("part"))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col(y) == F.lit(k), F.lit(min(1 << 30, int((1 << 30) * per_class / n)))).otherwise(share)
    return known.where(hashed < share).select("doc_id", y, F.pmod(F.xxhash64("doc_id", F.lit(salt + 1)), F.lit(2)).cast("int").alias("part"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60, balanced: bool = True) -> np.ndarray:
    """Weights, intercept last, of a logistic regression by Newton's method; balanced: the classes count alike."""
    if not len(y) or y.min() == y.max():
        return np.append(np.ones(x.shape[1]), 0.0)
    a = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y) if balanced else np.ones(len(y))
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (share * (p - y)) + ridge * w
        h = (a * (share * p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

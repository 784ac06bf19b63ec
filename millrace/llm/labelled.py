"""The bounded sample of labelled rows that the two classifiers fit on, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Most labelled rows that a fit reads; those with the least hash of their id.
FIT_ROWS = 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(text, y, part) of at most `rows` labelled rows that are not held out; part 0..9 splits them further.

    Only the sample's ids and labels are broadcast (`rows` pairs at most), so texts are not shuffled.
    Rows without an id or label teach nothing; of several labels of one id the largest counts."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    by_hash = F.xxhash64("doc_id")
    sample = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(by_hash, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)).cast("int").alias("part"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of ridge logistic regression by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

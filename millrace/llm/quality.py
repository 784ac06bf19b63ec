"""Operator 7, a quality classifier on random-indexing word vectors.

Every word form has a sparse random index vector; a form's vector is the sum of
the index vectors of its neighbours over the whole corpus.  Forms are hashed to
a fixed number of rows, so the vectors are one matrix of known size however
large the corpus is.  A document is the mean and spread of its words' vectors;
a network of two layers turns that into a probability, whose temperature is
fitted on labelled rows that the network did not see.

Defined results: null and empty texts are the zero vector and get its score;
without labels of both classes every text gets the share of good labels (0.5
if there is none), and so does an empty table of documents or labels; repeated
rows score alike and teach once by id, rows without an id teach nothing; texts of
any length are pooled whole; a kept column named score gives way to the new one.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .labelled import FIT_ROWS, fit_sample, sigmoid

ROWS, SIZE, NONZERO, REACH = 8_192, 32, 4, 2
_BLOCK = 64
_SLICE = 200_000
_CACHE = 500_000
SYMBOLS = frozenset("#*$%&|<>!?~^_=+@{}[]\\")


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector; the last row is empty."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((ROWS + 1, SIZE)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (ROWS + 1, NONZERO))
    signs[ROWS] = 0
    return places, signs


def form(chunk: str) -> str:
    """The form that a run between white space counts as: its symbols, its capitals, or its letters in lower case."""
    marks = "".join(c for c in chunk if c in SYMBOLS)
    if marks:
        return marks[:4]
    core = "".join(c for c in chunk if c.isalnum())
    if core.isdigit():
        return "0" * min(len(core), 8)
    return "CAPS" if len(core) > 1 and core.isupper() else core.lower() or chunk[:4]


class _Rows(dict):
    """Row of each chunk, filled in when first seen."""

    def __missing__(self, chunk: str) -> int:
        row = zlib.crc32(form(chunk).encode()) % ROWS
        if len(chunk) < 64:
            if len(self) >= _CACHE:
                self.clear()
            self[chunk] = row
        return row


@cache
def _rows() -> _Rows:
    return _Rows()


def rows_of(text: str) -> list[int]:
    return list(map(_rows().__getitem__, text.split()))


def _slices(texts: list[str]):
    """Rows of texts, parted by empty rows, in slices of about _SLICE words."""
    ids: list[int] = []
    for text in texts:
        ids += rows_of(text)
        ids += [ROWS] * REACH
        if len(ids) > _SLICE:
            yield np.array(ids)
            ids = []
    if ids:
        yield np.array(ids)


def _contexts(batches):
    places, signs = index_vectors()
    total = np.zeros((ROWS + 1) * SIZE)
    for batch in batches:
        for ids in _slices(batch.column(0).to_pylist()):
            for d in range(1, REACH + 1):
                for a, b in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                    for k in range(NONZERO):
                        total += np.bincount(a * SIZE + places[b, k], signs[b, k], total.size)
    blocks = total[: ROWS * SIZE].reshape(ROWS // _BLOCK, -1)
    at = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(blocks[at]), pa.list_(pa.float64()))], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The corpus's word vectors: each task sums its own, blocks of rows are summed up on the executors.

    The matrix that comes back has ROWS x SIZE numbers at any corpus size."""
    parts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(_contexts, "block long, sums array<double>")
    total = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).select("block", vector_to_array("sums").alias("sums"))
    out = np.zeros((ROWS, SIZE))
    for row in total.collect():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.array(row["sums"]).reshape(_BLOCK, SIZE)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text; zeros for a text without words."""
    out = np.zeros((len(texts), 2 * SIZE))
    for i, text in enumerate(texts):
        ids = rows_of(text)
        if ids:
            n = np.bincount(ids)
            at = np.flatnonzero(n)
            share = n[at] / len(ids)
            own = vectors[at]
            mean = share @ own
            out[i, :SIZE] = mean
            out[i, SIZE:] = np.sqrt(np.maximum(share @ own**2 - mean**2, 0))
    return out


class Network:
    """Two layers: tanh, then one logit; probabilities at a fitted temperature."""

    def __init__(self, hidden: int = 24, seed: int = 11):
        self.hidden, self.seed, self.temperature, self.share = hidden, seed, 1.0, 0.5
        self.layers = None

    def fit(self, x: np.ndarray, y: np.ndarray, part: np.ndarray, steps: int = 1500) -> None:
        if y.size:
            self.share = float(y.mean())
        if not y.size or not 0 < y.mean() < 1:
            return
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.std
        fit, rest = part < 8, part >= 8
        if not fit.any() or not rest.any():
            fit = rest = np.ones(y.size, bool)
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        rows = np.flatnonzero(fit)
        for t in range(1, steps + 1):
            at = rng.choice(rows, min(512, rows.size), replace=False)
            h = np.tanh(z[at] @ w[0] + w[1])
            e = (sigmoid(h @ w[2] + w[3]) - y[at]) / at.size
            back = np.outer(e, w[2]) * (1 - h**2)
            grads = [z[at].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ e + 1e-4 * w[2], np.array([e.sum()])]
            for p, g, m, v in zip(w, grads, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.layers = w
        logits = self.logits(x[rest])
        loss = lambda k: np.mean(np.logaddexp(0, -np.where(y[rest] > 0, 1, -1) * logits / k))
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.tanh((x - self.mean) / self.std @ w[0] + w[1]) @ w[2] + w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return sigmoid(self.logits(x) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", rows: int = FIT_ROWS) -> Network:
    """Fit the network on at most `rows` labelled rows that are not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "part", "x"])

    got = fit_sample(docs, labels, label, rows).mapInArrow(features, "y int, part int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, 2 * SIZE)
    y, part = (got.column(k).to_numpy() for k in ("y", "part"))
    order = np.lexsort((*x.T[:4], part, y))  # the same rows give the same network in whatever order they come
    network = Network()
    network.fit(x[order], (y[order] > 0).astype(float), part[order])
    return network


def score(docs: DataFrame, vectors: np.ndarray, network: Network, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and score of every text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *without(keep, ("score",)))
    schema = rows.drop("__text").withColumn("score", F.lit(0.0)).schema

    def scored(batches):
        vectors, network = shared.value
        for batch in batches:
            p = network.predict(pooled(batch.column(0).to_pylist(), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return rows.mapInArrow(scored, schema)

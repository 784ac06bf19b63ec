"""Operator 10, toxic passages as maximum-scoring segments.

Token scores are log-odds of the toxic class against the other with Dirichlet
priors from both classes together; tokens without significant odds get a small
negative score.  A word without odds of its own takes those of its stem (its
first five or four letters), which are counted like words.  One linear scan over a text finds every maximal segment
(disjoint, none can be extended or joined with gain).  Best scores of texts that
are not toxic follow an extreme-value law whose two parameters give every
segment an expected count by chance; significant segments are summed up and the
sum is mapped to a probability on the labelled sample.

Defined results: null, empty and wordless texts have no segment and get the
score of a text without any; without labels of both classes every text gets the
share of toxic labels (0 if there is none); an empty table of documents or labels
fits such a model; tokens that tie are taken in order, repeated rows get equal
scores and teach once by id; texts of any length are scanned whole; a kept column
may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, without, words_of
from .labelled import FIT_ROWS, fit_sample, logistic, sigmoid

PRIOR = 1_000.0
#: Least likelihood ratio of a token's counts in the two classes (twice its log).
RATIO = 20.0
#: Odds of less than three to one are left out: topics differ that much by chance.
LEAST_ODDS = float(np.log(3))
LEAST_COUNT = 5
#: Most tokens with a score of their own; those with the most significant odds.
TOKENS = 50_000
DRIFT = 0.15
EXPECTED = 0.05
_CACHE = 500_000


def stems(word: bytes) -> list[bytes]:
    """Marks for the first five and four letters of a longer word, the longer one first."""
    letters = word.decode("utf-8", "ignore")
    return [b"^" + letters[:k].encode() for k in (5, 4) if len(letters) > k]


class _Scores(dict):
    """Score of each word: its own, else its stem's, else the negative drift; filled in when first seen."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> float:
        score = next((self.known[s] for s in stems(word) if s in self.known), -DRIFT)
        if len(word) < 64:
            if len(self) >= _CACHE:
                self.clear()
                self.update(self.known)
            self[word] = score
        return score

    def __reduce__(self):
        return _Scores, (self.known,)


def _counted(batches):
    total: dict[tuple[bytes, int], int] = {}

    def rows():
        keys = list(total)
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.binary()), pa.array([k[1] for k in some], pa.int32()), pa.array([total[k] for k in some], pa.int64())], ["token", "y", "n"])

    for batch in batches:
        for data, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(words_of(data))
            for token in words.union(*map(stems, words)):
                total[token, y] = total.get((token, y), 0) + 1
        if len(total) > 500_000:
            yield from rows()
            total.clear()
    yield from rows()


def token_scores(sample: DataFrame, tokens: int = TOKENS) -> dict[bytes, float]:
    """Significant log-odds by token, at most `tokens` of them, summed up on the executors.

    A token counts once a document, as words come in bursts."""
    counts = sample.select(F.col("text").cast("binary"), "y").mapInArrow(_counted, "token binary, y int, n long")
    by_token = counts.groupBy("token").agg(F.sum(F.col("n") * (F.col("y") > 0).cast("long")).alias("a"), F.sum(F.col("n") * (F.col("y") <= 0).cast("long")).alias("b"))
    by_token = stored(by_token)
    total = by_token.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n_a, n_b = total["a"] or 0, total["b"] or 0
    if not n_a or not n_b:
        return {}
    a, b = F.col("a"), F.col("b")
    prior = PRIOR * (a + b) / (n_a + n_b)
    x, y = a + prior, b + prior
    odds = F.log(x / (n_a + PRIOR - x)) - F.log(y / (n_b + PRIOR - y))
    part = lambda k, n: F.when(k > 0, k * F.log(k * (n_a + n_b) / ((a + b) * n))).otherwise(0.0)
    ratio = 2 * (part(a, n_a) + part(b, n_b))
    scored = by_token.where(a + b >= LEAST_COUNT).where((x < n_a + PRIOR) & (y < n_b + PRIOR)).select("token", odds.alias("odds"), ratio.alias("ratio"))
    top = scored.where((F.col("ratio") >= RATIO) & (F.abs("odds") >= LEAST_ODDS)).orderBy(F.desc("ratio"), "token").limit(tokens)
    return {bytes(r["token"]): float(r["odds"]) for r in top.collect()}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by one linear scan over the positive positions."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, sum before, sum after, index of the last one that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        now = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = now[4] = _lower(found, len(found) - 1, now[2])
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(s[0], s[1], float(s[3] - s[2])) for s in found]


def _lower(found: list[list], j: int, level: float) -> int:
    while j >= 0 and found[j][2] >= level:
        j = found[j][4]
    return j


class Model:
    """Token scores, extreme-value parameters and the final mapping."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = _Scores({t: s - DRIFT for t, s in scores.items()})
        self.lam, self.log_k = 1.0, 0.0
        self.weights = None
        self.share = 0.0

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(data)
        scores = list(map(self.scores.__getitem__, words))
        if not scores or max(scores) <= 0:
            return len(words), []
        return len(words), segments(np.array(scores))

    def expected(self, n: int, score: float) -> float:
        """Log of the expected number of segments by chance that score as much."""
        return self.log_k + np.log(max(n, 1)) - self.lam * score

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
        logs = [-self.expected(n, s[2]) for s in found]
        good = [(s, x) for s, x in zip(found, logs) if x >= -np.log(EXPECTED)]
        return [np.log1p(sum(x for _, x in good)), np.log1p(max(0.0, max(logs, default=0.0))), float(np.log1p(len(good)))], [s for s, _ in good]

    def calibrate(self, n: np.ndarray, best: np.ndarray, y: np.ndarray) -> None:
        """Fit the extreme-value law by moments to the best scores of texts that are not toxic.

        The top hundredth is left out: some labels are wrong."""
        usual = (y <= 0) & (best <= np.quantile(best[y <= 0], 0.99))
        b, logs = best[usual], np.log(np.maximum(n[usual], 1))
        if b.size < 10:
            return
        for _ in range(100):
            spread = np.std(b - logs / self.lam)
            lam = float(np.clip(np.pi / np.sqrt(6) / max(spread, 1e-3), 0.05, 20))
            if abs(lam - self.lam) < 1e-9:
                break
            self.lam = 0.5 * (lam + self.lam)
        self.log_k = float(self.lam * b.mean() - logs.mean() - np.euler_gamma)

    def score(self, features: list[float]) -> float:
        if self.weights is None:
            return self.share
        return float(sigmoid(np.dot(self.weights[:-1], features) + self.weights[-1]))


def _scanned(model):
    def scan(batches):
        for batch in batches:
            n, starts, ends, scores = [], [], [], []
            for data in batch.column(0).to_pylist():
                count, found = model.value.scan(data)
                n.append(count)
                scores.append([s[2] for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["y", "n", "scores"])

    return scan


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on at most `rows` labelled rows that are not held out."""
    spark = docs.sparkSession.sparkContext
    sample = stored(fit_sample(docs, labels, label, rows))
    model = Model(token_scores(sample))
    shared = spark.broadcast(model)
    got = sample.select(F.col("text").cast("binary"), "y").mapInArrow(_scanned(shared), "y int, n long, scores array<double>").collect()
    shared.unpersist()
    y, n = np.array([r["y"] for r in got]), np.array([r["n"] for r in got])
    model.share = float(y.mean()) if y.size else 0.0
    if y.size and 0 < y.mean() < 1:
        model.calibrate(n, np.array([max(r["scores"], default=0.0) for r in got]), y)
        x = np.array([model.features(r["n"], [(0, 0, s) for s in r["scores"]])[0] for r in got])
        model.weights = logistic(x, y, ridge=1.0)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, score and passages (word ranges with their segment scores) of every text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"), *without(keep, ("score", "passages")))
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    none = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("score")))
    schema = rows.drop("__text").withColumns({"score": F.lit(0.0), "passages": none}).schema

    def scored(batches):
        model = shared.value
        for batch in batches:
            scores, passages = [], []
            for data in batch.column(0).to_pylist():
                x, good = model.features(*model.scan(data))
                scores.append(model.score(x))
                passages.append([{"start": s[0], "end": s[1], "score": s[2]} for s in good])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], names=[*batch.schema.names[1:], "score", "passages"])

    return rows.mapInArrow(scored, schema)

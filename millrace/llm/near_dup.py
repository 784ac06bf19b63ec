"""Operator 9, near-duplicate detection by consistent weighted sampling.

Texts are sets of five-word shingles weighted by count and inverse document
frequency.  Each text gets samples by improved consistent weighted sampling
(two texts agree in a sample with their weighted Jaccard similarity as
probability), samples are banded, and texts that share a band are compared by
exact weighted Jaccard similarity, with the same weights and, if that is too
little, with counts alone; so texts are linked that are alike in either.  Links
of 0.8 or more are closed to classes.  Within a band at least AGREE of the
samples must agree before texts are compared.

Document frequencies are held in a table of fixed size indexed by shingle hash,
summed over all documents.  Equal texts are one text until the end.  Within a
band, texts are reached from one another breadth first: a text that is reached
is compared with those that are not yet, so a cloud of near copies costs a few
comparisons a text and a text without a link is compared with all.  Bands with
the same members are searched once.  A band of more than MOST texts is dealt
into parts of about half that size, and every part is searched with itself and
with every other part, each pair of parts on its own; so all pairs of a band are
covered, and a search holds about MOST texts of it, whatever the band's size.

Defined results: null, empty and wordless texts are alone in their class; a
text of fewer than five words is one shingle; class_id is the least doc_id of
the class (null ids do not count); repeated rows are in one class; texts of any
length are compared whole; the empty table gives no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, words_of, working

WORDS, SIMILAR = 5, 0.8
BANDS, PER_BAND = 10, 4
SAMPLES = BANDS * PER_BAND
#: Cells of the document-frequency table and of a row of it on the way.
CELLS, _BLOCK = 1 << 18, 1 << 10
#: Share of a shingle's weight that its inverse document frequency can add.
IDF_SHARE = 0.5
#: Most texts of a band that are searched together; a larger band is searched by pairs of parts of half as many.
MOST, MOST_BYTES = 4_000, 64_000_000
#: Samples that must agree before two texts are compared, of SAMPLES; at 0.8 fewer agree once in a million.
AGREE = 18
_CACHE = 400_000
_TABLE = 1 << 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = h
        return h


@cache
def _hashes() -> _Hashes:
    return _Hashes()


def shingles(data: bytes) -> np.ndarray:
    """Hashes of all runs of five words, or of the whole text if it is shorter."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_hashes().__getitem__, words)), np.uint64)
    n = max(1, h.size - WORDS + 1)
    out = np.full(n, min(h.size, WORDS), np.uint64)
    for i in range(min(h.size, WORDS)):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


#: Distinct shingles in order, their weights, and their counts.
Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def weighted(data: bytes, idf: np.ndarray) -> Features:
    got, counts = np.unique(shingles(data), return_counts=True)
    return got, counts * idf[(got & np.uint64(CELLS - 1)).astype(np.int64)], counts


def similarity(a: Features, b: Features) -> float:
    """Weighted Jaccard similarity by weights; if that is below SIMILAR, by counts where they give more."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    out = 0.0
    for k in (1, 2):
        shared = np.minimum(a[k][i], b[k][j]).sum()
        total = a[k].sum() + b[k].sum() - shared
        out = max(out, float(shared / total) if total else 0.0)
        if out >= SIMILAR:
            break
    return out


def _sizes(features: list[Features]) -> np.ndarray:
    """Summed weights and counts of each text."""
    return np.array([(f[1].sum(), f[2].sum()) for f in features])


def _alike(sizes: np.ndarray, sigs: np.ndarray, p: int, others: np.ndarray) -> np.ndarray:
    """Which others may be similar to p: by their sizes, and by the samples that agree."""
    a, b = sizes[others], sizes[p]
    near = (np.minimum(a, b) >= SIMILAR * np.maximum(a, b)).any(axis=1)
    return near & ((sigs[others] == sigs[p]).sum(axis=1) >= AGREE)


@cache
def _draws():
    """Random tables for the samples, and a multiplier and shift for each sample that index them."""
    rng = np.random.default_rng(5)
    r = rng.gamma(2, 1, _TABLE).astype(np.float32)
    log_c = np.log(rng.gamma(2, 1, _TABLE)).astype(np.float32)
    beta = rng.random(_TABLE).astype(np.float32)
    return r, log_c, beta, rng.integers(1, 1 << 62, (SAMPLES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def samples(features: Features) -> np.ndarray:
    """SAMPLES consistent weighted samples of a text, each as a 32-bit mark of the shingle and its level."""
    h, weights, _ = features
    r, log_c, beta, multiply = _draws()
    best, mark = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64)
    for at in range(0, h.size, 2_000):
        part, log_w = h[at : at + 2_000], np.log(weights[at : at + 2_000]).astype(np.float32)
        mixed = part * multiply
        cell = (mixed >> np.uint64(48)).astype(np.intp)
        rate, offset = r[cell], beta[cell]
        level = np.floor(log_w / rate + offset)
        value = log_c[cell] - rate * (level - offset + 1)
        first = value.argmin(axis=1)
        row = np.arange(SAMPLES)
        low = value[row, first]
        better = low < best
        marks = (part[first] ^ (part[first] >> np.uint64(31))).astype(np.int64) * 31 + level[row, first].astype(np.int64)
        best[better], mark[better] = low[better], marks[better]
    return (mark ^ (mark >> 32)).astype(np.int32)


def document_frequency(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf-weight of each cell: 1 for shingles that every text has, to 1 + IDF_SHARE for cells of no more than chance."""

    def counted(batches):
        working("near_dup", _hashes)
        total, rows, waiting, size = np.zeros(CELLS), 0, [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = np.unique(shingles(data))
                waiting.append((got & np.uint64(CELLS - 1)).astype(np.int64))
                rows += got.size > 0
                size += got.size
                if size > 500_000:
                    total += np.bincount(np.concatenate(waiting), minlength=CELLS)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=CELLS)
        blocks = total.reshape(-1, _BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([np.full(1, rows, float), *blocks[at]], pa.list_(pa.float64()))], ["block", "counts"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("text"))
    parts = texts.mapInArrow(counted, "block long, counts array<double>")
    summed = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("counts")).alias("counts")).select("block", vector_to_array("counts").alias("counts"))
    out, n = np.zeros(CELLS), 1.0
    for row in summed.collect():
        if row["block"] < 0:
            n = max(1.0, row["counts"][0])
        else:
            out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = row["counts"]
    floor = max(1.0, float(np.median(out)))
    share = np.log(n / np.clip(out, floor, n)) / np.log(n / floor) if n > floor else np.ones(CELLS)
    return (1 + IDF_SHARE * share).astype(np.float32)


def _signatures(docs: DataFrame, idf, text: str, keep: list[str]) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"), *keep)
    schema = rows.drop("__text").withColumn("sig", F.array(F.lit(0))).schema

    def signed(batches):
        working("near_dup", _hashes)
        for batch in batches:
            sigs = []
            for data in batch.column(0).to_pylist():
                features = weighted(data, idf.value)
                sigs.append(samples(features) if features[0].size else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sigs, pa.list_(pa.int32()))], names=[*batch.schema.names[1:], "sig"])

    return rows.mapInArrow(signed, schema)


def reached(features: list[Features], sigs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the texts of a band, breadth first: (one that was reached, one that it reaches)."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(features))
    sizes = _sizes(features)
    while left.size > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            p = queue.pop(0)
            may = _alike(sizes, sigs, p, left)
            found = [int(i) for i in left[may] if similarity(features[p], features[i]) >= SIMILAR]
            out += [(p, i) for i in found]
            queue += found
            left = left[~np.isin(left, found)] if found else left
    return out


def reached_across(features: list[Features], sigs: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Links between the first and the second part of a band that join what any link between them joins, breadth first."""
    out: list[tuple[int, int]] = []
    sizes = _sizes(features)
    left = [np.flatnonzero(~second), np.flatnonzero(second)]
    while left[0].size and left[1].size:
        queue, left[0] = [int(left[0][0])], left[0][1:]
        while queue:
            p = queue.pop(0)
            side = int(not second[p])
            others = left[side]
            may = _alike(sizes, sigs, p, others)
            found = [int(i) for i in others[may] if similarity(features[p], features[i]) >= SIMILAR]
            out += [(p, i) for i in found]
            queue += found
            left[side] = others[~np.isin(others, found)] if found else others
    return out


def _linked(idf):
    """Batches of (band, a, b, part, key, sig, text), sorted: parts a and b of a band are searched together, or a alone if they are the same."""

    def linked(batches):
        working("near_dup", _hashes)

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for (_, a, b), group in groupby(rows(), key=lambda r: r[:3]):
            group = list(group)
            features, sigs = [weighted(r[6], idf.value) for r in group], np.array([r[5] for r in group])
            found = reached(features, sigs) if a == b else reached_across(features, sigs, np.array([r[3] == b for r in group]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([group[i][4] for i, _ in found], pa.binary()), pa.array([group[j][4] for _, j in found], pa.binary())], ["a", "b"])

    return linked


def text_key(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def links(docs: DataFrame, keys: DataFrame, idf, doc_id: str, text: str) -> DataFrame:
    """Verified links (a, b), stored, that join similar texts. keys: (key, doc_id, size, sig) of every row with words."""
    distinct = stored(keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sig").alias("sig")))
    band = [F.xxhash64(F.lit(i), F.slice("sig", i * PER_BAND + 1, PER_BAND)) for i in range(BANDS)]
    members = distinct.select("key", "size", F.explode(F.array(*band)).alias("band"))
    own = F.xxhash64("key")
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(own.cast("decimal(38,0)")).alias("sum"), F.min(own).alias("least")).where("n > 1")
    once = sizes.groupBy("n", "sum", "least").agg(F.min("band").alias("band"), F.first("bytes").alias("bytes")).select("band", "n", "bytes")
    members = stored(members.drop("size").join(once, "band"))
    reps = distinct.join(members.select("key").distinct(), "key").select("key", "doc_id")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    on = (texts["key"] == reps["key"]) & texts["doc_id"].eqNullSafe(reps["doc_id"])
    texts = stored(texts.join(reps, on).select(reps["key"], "text").dropDuplicates(["key"]))
    fits = (F.col("n") <= MOST) & (F.col("bytes") <= MOST_BYTES)
    parts = F.when(fits, 1).otherwise(F.least("n", F.ceil(2 * F.greatest(F.col("n") / MOST, F.col("bytes") / MOST_BYTES)))).cast("int")
    dealt = members.withColumns({"part": F.pmod(F.xxhash64("key", "band"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))})
    dealt = dealt.select("band", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "key")
    dealt = dealt.join(distinct.select("key", "sig"), "key").join(texts, "key").select("band", "a", "b", "part", "key", "sig", "text")
    sorted_ = dealt.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b", "key")
    found = stored(sorted_.mapInArrow(_linked(idf), "a binary, b binary"))
    dropped(distinct, members, texts)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key in an edge, by alternating large and small stars; the root is the least key."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, stored(small.select("e.u", "e.v").where("u != v").distinct())
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        seen = now


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (digest of the text), class_id and class_size of every row."""
    spark = docs.sparkSession.sparkContext
    idf = spark.broadcast(document_frequency(docs, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", text_key(F.col("text")))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    signed = stored(_signatures(rows, idf, "text", ["doc_id", "key", "size"]))
    with_words = signed.where(F.size("sig") > 0)
    roots = components(links(docs, with_words, idf, doc_id, text))
    per_key = with_words.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    per_key = per_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    per_root = per_key.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_key = per_key.join(per_root, "root").select("key", "class_id", "class_size")
    known = with_words.select("doc_id", "key").join(by_key, "key")
    alone = signed.where(F.size("sig") == 0).select("key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return known.unionByName(alone).select("doc_id", "key", "class_id", "class_size")

"""Operator 1, language ID by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (one to three
letters, word boundary included) of a language, by rank.  A document gets the
language whose profile has the least out-of-place distance to the document's
own most frequent n-grams.

Defined results: null, empty and letterless texts are ``und`` with score 0;
equal counts rank by code point, equal distances go to the language that sorts
first; rows with a null language or text teach nothing, repeated rows teach as
often as they occur and get equal results; with no profile at all every text is
``und``; texts of any length count whole; the empty table gives no rows; a kept
column may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import without, working

PROFILE = 300
_SLICE = 1_000_000
_FLUSH = 2_000_000


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.int64, 0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """All n-grams of a text as integers of 21 bits a letter; empty if it has no letter."""
    a = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    a = np.concatenate(([32], a, [32]))
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    if a.size < 3:
        return np.empty(0, np.int64)
    pairs = a[:-1] | a[1:] << 21
    return np.concatenate((a[a != 32], pairs, pairs[:-1] | a[2:] << 42))


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order with their counts (or summed weights)."""
    if weights is None:
        codes = np.sort(codes)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if codes.size else np.empty(0, np.int64)
        return codes[starts], np.diff(starts, append=codes.size)
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if codes.size else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(weights, starts) if codes.size else weights


def top_ngrams(text: str, size: int = PROFILE) -> np.ndarray:
    """The document's most frequent n-grams, best first."""
    codes, counts = counted(ngram_codes(text))
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("langid", _letters)
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merged(lang):
        parts = kept[lang]
        return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def rows():
        for lang in kept:
            codes, counts = merged(lang)
            for at in range(0, codes.size, 100_000):
                c = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * c.size, pa.string()), pa.array(c), pa.array(counts[at : at + 100_000])], ["lang", "code", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for i in sorted(range(len(texts)), key=lambda i: langs[i]):
            codes = ngram_codes(texts[i])
            waiting.setdefault(langs[i], []).append(codes)
            size += codes.size
            if size > _SLICE:
                for lang, lists in waiting.items():
                    kept.setdefault(lang, []).append(counted(np.concatenate(lists)))
                    held += kept[lang][-1][0].size
                waiting, size = {}, 0
        for lang, lists in waiting.items():
            kept.setdefault(lang, []).append(counted(np.concatenate(lists)))
            held += kept[lang][-1][0].size
        if held > _FLUSH:
            kept = {lang: [merged(lang)] for lang in kept}
            held = sum(p[0][0].size for p in kept.values())
            if held > _FLUSH // 2:  # too many distinct n-grams to hold: hand on what there is
                yield from rows()
                kept, held = {}, 0
    yield from rows()


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, code, rank) from every row with a text and a language.

    N-grams are counted within each task, summed by (lang, code), and only the
    first `size` of a language leave a task for the final ranking."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = known.mapInArrow(_partial_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(by_count) - 1).where(F.col("rank") < size).select("lang", "code", "rank")


class Profiles:
    """Profiles as one sorted code list and a rank for each language and code."""

    def __init__(self, rows: list, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.codes = np.array(sorted({r["code"] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), self.codes.size + 1), -1, np.int64)
        at = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            self.ranks[at[r["lang"]], np.searchsorted(self.codes, r["code"])] = r["rank"]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score 1 - distance / largest distance, and lead over the next language."""
        top = top_ngrams(text, self.size) if text else np.empty(0, np.int64)
        if not top.size or not self.langs:
            return "und", 0.0, 0.0
        at = np.searchsorted(self.codes, top)
        at[(at < self.codes.size) & (self.codes[np.minimum(at, self.codes.size - 1)] != top)] = self.codes.size
        ranks = self.ranks[:, at]
        out = np.where(ranks >= 0, np.abs(ranks - np.arange(top.size)), self.size).sum(axis=1)
        best = int(np.argmin(out))
        most = float(self.size * top.size)
        rest = np.delete(out, best)
        lead = (rest.min() - out[best]) / most if rest.size else (most - out[best]) / most
        return self.langs[best], float(np.clip(1 - out[best] / most, 0, 1)), float(lead)


def identify(docs: DataFrame, profiles: DataFrame, keep: list[str], text: str = "text", size: int = PROFILE) -> DataFrame:
    """Each row's `keep` columns with lang_pred, score and lead.

    What is sent to the executors is `size` rows a language, no more."""
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles.collect(), size))
    rows = docs.select(F.col(text).alias("__text"), *without(keep, ("lang_pred", "score", "lead")))
    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "lead": F.lit(0.0)}).schema

    def predicted(batches):
        working("langid", _letters)
        for batch in batches:
            got = [model.value.predict(t) for t in batch.column(0).to_pylist()]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "lang_pred", "score", "lead"])

    return rows.mapInArrow(predicted, schema)

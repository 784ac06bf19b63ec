"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the result is written as Parquet and read again.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, langid, near_dup, pii
from millrace.llm.common import dropped, held_out, live, read, ship, small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose n-grams are no nearer to its language than this share of the largest distance is rejected.
LEAST_SCORE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null, empty, no letter) or far from every profile; lang becomes the predicted one.

    Equal texts are judged alike; equal distances go to the language that sorts first; no documents give no rows."""
    ship(spark)
    profiles = langid.learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.withColumn("copy", F.col("text")), profiles, COLUMNS, text="copy")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class, once.

    Documents without an id give way to any of their class that has one; of classes without any id, each different
    text stays once. Null and empty texts are alone in their class and stay."""
    found = near_dup.classes(docs)
    keys = docs.select(*COLUMNS).withColumn("key", near_dup.text_key(F.col("text")))
    first = found.groupBy("class_id").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("key"))).alias("key")).where("class_id is not null")
    named = keys.join(first.withColumnRenamed("class_id", "doc_id"), ["doc_id", "key"], "left_semi")
    again = found.where("doc_id = class_id").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # repeated rows
        named = named.dropDuplicates(["doc_id", "key"])
    nameless = keys.where("doc_id is null").join(found.where("class_id is null").select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return named.select(*COLUMNS).unionByName(nameless.select(*COLUMNS)) if not found.where("doc_id is null").isEmpty() else named.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: a twentieth of the words or more lie in benchmark passages.

    Texts without words stay, and so does everything if the benchmark is empty; equal texts are judged alike."""
    found = decontaminate.decontaminate(docs.withColumn("copy", F.col("text")), read(spark, sf_dir, "benchmark"), COLUMNS, text="copy")
    hit = decontaminate.n_hit()
    return found.where(~((hit > 0) & (20 * hit >= F.col("n_words")))).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text; null texts stay null."""
    ship(spark)
    return pii.redact(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text; null counts as empty."""
    import public_tokenizers

    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


_left: list[DataFrame] = []


def _tidy(stage):
    """The stage, which first deletes what earlier stages stored on their way, unless its input still reads it.

    Python workers get small batches in it."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        files = docs.inputFiles() if _left else []
        gone = [t for t in _left if not any(t.stored_at.rsplit("/", 1)[1] in f for f in files)]
        dropped(*gone)
        before = {t.stored_at for t in live()}
        out = stage(spark, docs, sf_dir)
        _left[:] = [t for t in live() if t.stored_at not in before]
        return out

    return tidied


STAGES = [(stage.__name__, _tidy(stage)) for stage in (language, near_duplicates, decontamination, personal_data, tokens)]

#: Profiles, sampling, bootstrapping and BPE have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written to the shared folder.

    A stage's result is deleted when the next one's is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)

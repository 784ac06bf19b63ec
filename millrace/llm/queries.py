"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, filter_audit, langid, licenses, near_dup, pii, quality, rules, suffix_dedup, toxicity, word_dedup
from .common import held_out, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = langid.learn_profiles(docs.where("not held_out"))
    return langid.identify(docs, profiles, ["doc_id", "held_out"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(read(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), (F.size("spans") > 0).alias("has_personal_data"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), ["doc_id"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), ["doc_id"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], ids=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_rules(read(spark, sf_dir, "documents"), ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    metrics = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *metrics, failed.alias("base_failed"), "kept")


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs
), starts AS (
  SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8
), windows AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS s FROM starts
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid
), metrics AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters
  FROM words LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words
    OR (n_letters >= 20 AND 100 * n_upper > 50 * n_letters)
    OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
    OR (n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))) AS kept
FROM metrics
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, read(spark, sf_dir, "labels"), vectors)
    scored = quality.score(docs.withColumn("held_out", held_out(F.col("doc_id"))), vectors, network, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs, benchmark, ["doc_id"]).withColumn("n_hit", decontaminate.n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_near",
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_dedup.remove_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM starts
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, k: ps IS NULL OR NOT list_contains(ps, k)), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_pii, op3_licenses, op4_suffix_dedup, op5_bpe, op6_quality_rules, op7_quality_classifier, op8_decontamination, op9_near_duplicates, op10_toxicity, op11_conversation_repair, op12_filter_audit, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle_sql(), "op6_quality_rules": OP6_SQL, "op11_conversation_repair": conversations.SQL, "op12_filter_audit": filter_audit.SQL, "op13_substring_dedup": OP13_SQL}

"""Operator 12, interaction of filters by direct relational replay.

Every document's failures are crossed with all orders of the filters (a broadcast table whose size depends on the number
of filters alone: 120 rows for five), the order's steps are exploded, the first failure in the order decides where the
document goes, and one conditional aggregation, combined on the map side, counts what each step keeps and removes. Texts
are read once: a row that enters the replay holds a part, a bit a filter and the two labels.

Filter E looks at the whole table: a digest of the text (SHA-256) stands for it, the least id of each digest that has two
different ids is found by an aggregation with map-side combining, and joined back by digest; rows are small, and Spark
splits the partition of a hot digest as it does for any skewed sort-merge join.

Defined results: a null text is the empty text (fails A alone, and E if an empty text has a smaller id); a null part is
the part of the empty string; a row without id is no copy and makes none; rows that repeat an id are counted each, and
are no copies of each other by that; labels that are null or absent count for nothing, a document with several rows of
labels has a label if any row says so; the empty table gives no rows; texts of any length are measured whole; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, stored
from .rules import words_in

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that a text fails by itself."""
    words = words_in(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and bits (bit k set: the k-th of FILTERS fails) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    alone = text_failures(F.col("text"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    bits = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in alone.items()), F.lit(0))
    rows = stored(rows.select("id", "part", bits.alias("bits"), digest(F.col("text").cast("binary")).alias("text_key")))
    first = rows.groupBy("text_key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(first, "text_key", "left").select("id", "part", (F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("bits"))


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows with good and toxic, 0 or 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return rows.join(known, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters: filter_order and masks, the bits of its filters in turn."""
    rows = [("".join(p), [1 << filters.index(k) for k in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, masks array<int>")


def replay(rows: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, over rows with part, bits, good and toxic."""
    mask = lambda k: F.col("masks")[k]
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(F.col("bits").bitwiseAND(mask(k)) != 0, k + 1).otherwise(first)
    crossed = rows.select("part", "bits", "good", "toxic").crossJoin(F.broadcast(orders(rows.sparkSession)))
    steps = crossed.select("part", "bits", "good", "toxic", "filter_order", first.alias("first"), F.posexplode("masks").alias("at", "mask"))
    steps = steps.withColumn("step", F.col("at") + 1)
    removed, fails = F.col("first") == F.col("step"), F.col("bits").bitwiseAND(F.col("mask")) != 0
    conditions = (
        F.col("first") > F.col("step"),
        removed,
        fails & (F.col("first") < F.col("step")),
        F.col("bits") == F.col("mask"),
        removed & (F.col("good") == 1),
        removed & (F.col("toxic") == 1),
    )
    counted = steps.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(n) for n, c in zip(COUNTS, conditions)])
    # 600 rows a part from here on
    same_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(same_filter))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row for each
    part, order and step. The smallest ids of texts come from all of docs, whatever a filter removes."""
    return replay(labelled(failures(docs, doc_id, text, part), labels, doc_id))


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs
), flags AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM words
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), rated AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), replayed AS (
  SELECT part, filter_order, step, failed, good, toxic, substr(filter_order, step::BIGINT, 1) AS letter,
    length(regexp_extract(translate(filter_order, failed, repeat('!', length(failed))), '^[^!]*')) + 1 AS first
  FROM rated, orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step::INT AS step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (contains(failed, letter) AND first < step) AS redundant, count(*) FILTER (failed = letter) AS unique_fails,
    count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
  FROM replayed GROUP BY ALL
)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted
"""

"""Operator 6, quality rules as a short-circuit cascade, in DataFrame functions only.

Metrics of a text are columns; a rule is a condition on metrics that rejects a
text.  On a sample, which a hash of the text draws, one job estimates each rule's
selectivity (share of rows it rejects) and cost (work on a row, by the row's
characters and words, weighted by WORK), and the rules form one CASE in order of
rejection per cost, so a row stops at the first rule that rejects it.  Equal
tables give equal orders, on any machine and however they are partitioned.
Letters and capitals are counted within their rule alone, so only rows that come
so far pay for it.  The order changes the time, never the verdict.

Defined results: null and empty texts have no words and zero metrics (and are
too short for the base rules); repeated rows get equal results, rules that tie
go by name; texts of any length are measured whole; the empty table gives no
rows; a kept column may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: White space that parts words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows of the sample, about; it bounds the cost of ordering and nothing else.
SAMPLE_ROWS = 2_000
#: Work of each rule on a character and on a word, in units of 10 ns as timed on 25 million characters.
WORK = {"too_short": (5, 0), "repeats": (5, 120), "symbols": (10, 0), "capitals": (5, 0), "same_lines": (4, 0), "word_length": (10, 0)}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words in the union of windows that begin at the sorted starts."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), s + WINDOW - acc["end"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words.

    Everything is computed within the row: no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    rows = docs.withColumns({"__words": words_in(t), "__lines": lines})
    # __hashes is used more than once below, or else Spark would compute it again for every window
    # each word as a hash and each window as a hash of those; equal hashes stand for equal windows (64 bits, within one text)
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    hashes = F.transform(F.sequence(F.lit(1), F.size("__hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)))
    rows = rows.withColumn("__windows", F.when(F.size("__hashes") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    in_order = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__sorted", F.when(twice, in_order))
    # a window counts if the next or the previous of the sorted ones equals it
    pairs = F.zip_with(
        F.slice("__sorted", 1, F.size("__sorted") - 1),
        F.slice("__sorted", 2, F.size("__sorted") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    rows = rows.withColumn("__starts", F.when(twice, F.array_sort(F.array_distinct(F.flatten(pairs)))))
    return rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_repeat_words": F.coalesce(_covered(F.col("__starts")), F.lit(0)).cast("long"),
        }
    ).drop("__words", "__lines", "__hashes", "__windows", "__sorted", "__starts")


def rules(text: str = "text") -> dict[str, Column]:
    """Conditions that reject a text, over the metrics of with_metrics and the text itself."""
    c, t = F.col, F.coalesce(F.col(text), F.lit(""))
    upper, letters = (F.length(F.regexp_replace(t, rf"[^\p{{{kind}}}]+", "")) for kind in ("Lu", "L"))
    return {
        "too_short": c("n_words") < 20,
        "repeats": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 30 * c("n_words"),
        "capitals": (upper >= 10) & (letters >= 20) & (100 * upper > 50 * letters),
        "same_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines")),
        "word_length": (c("n_words") >= 20) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
    }


def rule_order(docs: DataFrame, conditions: dict[str, Column], text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per cost, best first, as a sample of about `rows` rows shows them; ties by name.

    A rule that WORK does not know counts as one of ten units a character."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.select(t.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    columns = []
    for name, condition in conditions.items():
        a, b = WORK.get(name, (10, 0))
        columns += [F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias(f"rejected {name}"), F.avg(a * F.length("text") + b * F.col("n_words")).alias(f"cost {name}")]
    got = with_metrics(sample).agg(*columns).first()
    score = {n: ((got[f"rejected {n}"] or 0.0) + 1e-6) / max(got[f"cost {n}"] or 0.0, 1.0) for n in conditions}
    return sorted(conditions, key=lambda n: (-score[n], n))


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """The first rule in order that rejects the row, or null if none does."""
    out = None
    for name in order:
        out = out.when(conditions[name], name) if out is not None else F.when(conditions[name], name)
    return out if out is not None else F.lit(None).cast("string")


def apply_rules(docs: DataFrame, keep: list[str], text: str = "text", order: list[str] | None = None) -> DataFrame:
    """`keep`, the metrics, rejected_by (a rule or null) and kept.

    rejected_by depends on the estimated order where several rules reject a row; kept does not."""
    order = order or rule_order(docs, rules(), text)
    keep = without(keep, (*METRICS, "rejected_by", "kept"))
    rows = with_metrics(docs.select(F.col(text).alias("__text"), *keep), "__text")
    rows = rows.withColumn("rejected_by", cascade(rules("__text"), order)).drop("__text")
    return rows.withColumn("kept", F.col("rejected_by").isNull())

"""Operator 3, licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: ASCII letters in lower case, copyright
lines left out, runs of ASCII punctuation and white space as one blank,
equivalent spellings as one.  The SHA-256 of the form is hash-joined to the
digests of known licences, so wrapping, case and punctuation do not matter.  A
copyright line has a year, a (c) or "by" after the word, as the licences' own
sentences about "the copyright notice" have not; for notices of several lines
the text is also looked up without the lines that follow one, up to a blank line
or MORE_LINES.  Each line that may be a notice of a licence is looked up, too, in
the row itself, as such notices stand on a line of their own.

Defined results: null and empty texts have no licence; equal notices count once
for each line; of several licences the names are sorted and given once; repeated
rows get equal results; texts of any length are looked up whole and line by line;
the empty table gives no rows; a kept column may have the name of a new one, which
then takes its place.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS, PLAIN = "‘’“”–— ©", "\"\"\"\"-- c"
#: A line that is a copyright notice, or says only that rights are reserved.
_YEAR = r"[<\[]?((19|20)[0-9][0-9]|year|yyyy)"
_NOTICE = rf"(^|\n)[ \t*#/;\-]*(copyright[ \t:,]*(\(c\)|c[ \t]|by[ \t]|{_YEAR})|(\(c\)|c)[ \t]+(copyright|by[ \t]|{_YEAR})|all rights reserved)[^\n]*"
COPYRIGHT = _NOTICE
#: The same with the lines after it, if they are not blank.
MORE_LINES = 3
COPYRIGHT_LINES = rf"{_NOTICE}(\n[^\n]*[^\n\t ][^\n]*){{0,{MORE_LINES}}}"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical_text(text: str) -> str:
    """The canonical form in plain Python, for the known texts."""
    t = text.translate(str.maketrans(UPPER + MARKS, LOWER + PLAIN))
    t = re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT, "\n", t)).strip(" ")
    return " ".join(SPELLINGS.get(w, w) for w in t.split(" "))


def known() -> list[tuple[str, str]]:
    """(digest, licence) of the known texts, with and without their titles, and of the notices."""
    titles = lambda i, title: {"", title, f"The {title}", f"{title} ({i})", f"The {title} ({i})", f"{i} License"}
    texts = [(i, f"{head}\n\n{body}") for i, title, body in TEXTS for head in titles(i, title)] + list(NOTICES)
    return sorted({(hashlib.sha256(canonical_text(t).encode()).hexdigest(), i) for i, t in texts} | set(DIGESTS))


def canonical(text: Column, notices: str = COPYRIGHT) -> Column:
    t = F.translate(text, UPPER + MARKS, LOWER + PLAIN)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, notices, "\n"), PUNCTUATION, " "))
    spellings = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.element_at(spellings, w), w)), " ")


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, license_id (of the whole text, or null), n_notices and notices of every row.

    The known digests are a fixed short list, which is broadcast; nothing is shuffled."""
    spark, listed_ = docs.sparkSession, known()
    t, keep = F.coalesce(F.col(text), F.lit("")), without(keep, ("license_id", "n_notices", "notices"))
    table = F.broadcast(spark.createDataFrame(listed_, "digest string, license string"))
    ids = F.create_map(*[F.lit(x) for pair in listed_ for x in pair])
    lines = F.filter(F.split(t, "\n"), lambda x: F.lower(x).contains("licen"))
    found = F.filter(F.transform(lines, lambda x: F.element_at(ids, _digest(canonical(x)))), lambda x: x.isNotNull())
    lower = F.lower(t)
    kept_as = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, kept_as)],
        _digest(canonical(t)).alias("__digest"),
        F.when(lower.contains("copyright") | lower.contains("(c)") | lower.contains("©"), _digest(canonical(t, COPYRIGHT_LINES))).alias("__other"),
        F.when(lower.contains("licen"), found).alias("__found"),
    )
    whole, other = table.toDF("__digest", "__license"), table.toDF("__other", "__more")
    joined = rows.join(F.broadcast(whole), "__digest", "left").join(F.broadcast(other), "__other", "left")
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(keep, kept_as)],
        F.coalesce("__license", "__more").alias("license_id"),
        F.coalesce(F.size("__found"), F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("__found")), ","), F.lit("")).alias("notices"),
    )


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(d)}, {q(i)})" for d, i in known())  # the digests of long texts are in it
    spellings = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in SPELLINGS.items()) + "}"

    def form(x: str, notices: str = COPYRIGHT) -> str:
        t = f"translate({x}, {q(UPPER + MARKS)}, {q(LOWER + PLAIN)})"
        t = f"trim(regexp_replace(regexp_replace({t}, {q(notices)}, chr(10), 'g'), {q(PUNCTUATION)}, ' ', 'g'), ' ')"
        return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: coalesce(element_at({spellings}, w)[1], w)), ' ')"

    return f"""
WITH known(digest, license_id) AS (VALUES {table}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
forms AS (SELECT rid, doc_id, sha256({form('t')}) AS digest, sha256({form('t', COPYRIGHT_LINES)}) AS other FROM docs),
whole AS (SELECT rid, doc_id, coalesce(k.license_id, m.license_id) AS license_id FROM forms f LEFT JOIN known k ON k.digest = f.digest LEFT JOIN known m ON m.digest = f.other),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE contains(lower(line), 'licen')),
hits AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names
  FROM (SELECT rid, sha256({form('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY rid
)
SELECT doc_id, license_id, coalesce(n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notices FROM whole LEFT JOIN hits USING (rid)
"""

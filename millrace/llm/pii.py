"""Operator 2, personal data by base patterns and bootstrapped contexts.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.
Those are the seeds: the words around a seed (left pair and right word, left
pair, right pair) are lexical patterns.  Every identifier-shaped word (one with
a digit or an at sign) and every run of digit groups joined by blanks, dots,
brackets or hyphens in the same kind of place is a candidate instance.
Patterns and instances form a weighted bipartite graph per kind, whose scores
are iterated on Spark: an instance is as likely as its patterns jointly make
it, a pattern as reliable as its instances, shrunk towards nothing where
support is small.  In each round the confident instances count as seeds do, so
they bring in patterns that no seed has.  Candidates of confident patterns are
added as spans of the pattern's kind.  They never overlap base spans or each
other; of those that would, the longest is taken.  Secrets (keys, access tokens) are a fifth
kind without base spans: long words of mixed letters and digits are its seeds, and
like other candidates they become spans only in places that confident patterns name.

Defined results: null and empty texts have no spans; equal texts, repeated rows and rows
without an id included, get equal spans; a tie between kinds goes to the one listed first;
texts of any length are searched whole; the empty table gives no rows; a kept column may
have the name of a new one, which then takes its place.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without, working

KINDS = ("email", "ip", "card", "phone")
#: Kinds in order: those of the base spans, then those found by patterns only.
ALL_KINDS = (*KINDS, "secret")
#: A pattern counts with at least so many different instances, and seeds or confident instances; scores are shrunk by PRIOR instances.
SUPPORT, SEEDS, PRIOR = 5, 3, 2.0
ROUNDS = 3
CONFIDENT = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{32,256}(?![A-Za-z0-9_+/-])")
_RUN = re.compile(r"(?:(?<![0-9A-Za-z])[0-9]|[+(]{1,2}[0-9])(?:[\x20\t().-]{0,3}[0-9])+(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the address runs back over local characters to the last match."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                done = domain.end()
                out.append((start, done))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match, by start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _word(word: str) -> str:
    """A word as patterns show it: lower case, digits as 0, a digest of it if it is long."""
    return re.sub("[0-9]", "0", word.lower()) if len(word) <= 24 else xxhash.xxh3_64_hexdigest(word.lower().encode())


def _neighbours(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two words before and after a span; text edges as '|'."""
    reach = 64
    while True:  # a third word shows that the two nearest are whole
        left = text[max(0, start - reach) : start].split()
        if len(left) > 2 or reach >= start:
            break
        reach *= 4
    reach = 64
    while True:
        right = text[end : end + reach].split(None, 2)
        if len(right) > 2 or end + reach >= len(text):
            break
        reach *= 4
    left, right = [_word(w) for w in left[-2:]], [_word(w) for w in right[:2]]
    return ["|"] * (2 - len(left)) + left, right + ["|"] * (2 - len(right))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    left, right = _neighbours(text, start, end)
    return [f"{left[0]} {left[1]} _ {right[0]}", f"{left[0]} {left[1]} _", f"_ {right[0]} {right[1]}"]


def shaped(text: str) -> list[tuple[int, int]]:
    """Identifier-shaped words: between white space, with a digit or an at sign, outer punctuation left off."""
    out, done = [], 0
    for m in _DIGIT.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        while start < end and not text[start].isalnum() and text[start] not in "+@":
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start >= 4:
            out.append((start, end))
    return out


def runs(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of adjacent digit groups with four digits or more, outside the spans that are taken."""
    out, at = [], 0
    for start, end in [*((a, b) for a, b, _ in taken), (len(text), len(text))]:
        if at < start:
            out += [m.span() for m in _RUN.finditer(text, at, start) if sum("0" <= c <= "9" for c in m.group()) >= 4]
        at = max(at, end)
    return out


class _Taken:
    """Places that overlap given spans."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [a for a, _, _ in spans], []
        for _, b, _ in spans:  # the furthest end so far, as spans of several kinds may overlap
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def __contains__(self, place: tuple[int, int]) -> bool:
        before = bisect_right(self.starts, place[1] - 1)
        return before > 0 and self.ends[before - 1] > place[0]


def _extracted(batches):
    working("pii")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        spans, places = [], []
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            got = [(a, b, k) for a, b, k in base]
            if _DIGIT.search(text):
                taken = _Taken(base)
                free = {x for x in shaped(text) if x not in taken}
                seeds = [m.span() for m in _SECRET.finditer(text) if m.span() not in taken]
                got += [(a, b, "secret") for a, b in seeds] + [(a, b, None) for a, b in sorted(free.union(runs(text, base), seeds))]
            places.append([{"start": a, "end": b, "kind": k, "instance": xxhash.xxh3_128_hexdigest(text[a:b].lower().encode()), "patterns": contexts(text, a, b)} for a, b, k in got])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, pa.list_(span)), pa.array(places, pa.list_(place))], names=[*batch.schema.names[1:], "base", "__places"])


def extract(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, __key (digest of the text), base spans and __places (seeds and candidates with their patterns); one scan, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("__text"), *keep, F.unhex(F.md5(t.cast("binary"))).alias("__key"))
    schema = "base array<struct<start: bigint, end: bigint, kind: string>>, __places array<struct<start: bigint, end: bigint, kind: string, instance: string, patterns: array<string>>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema.fields)
    return rows.mapInArrow(_extracted, f"{fields}, {schema}")


def score_graph(extracted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are confident after the last round.

    Edges are distinct (pattern, instance) pairs, so copies of a text add nothing, and patterns
    without support fall out by counting before any join; sums per side are combined before they are shuffled."""
    places = extracted.select(F.explode("__places").alias("p"))
    pairs = places.select(F.explode("p.patterns").alias("pattern"), "p.instance", "p.kind").distinct()
    support = pairs.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    edges = stored(pairs.join(support.where(f"n >= {SUPPORT}"), "pattern"))
    # seeds keep their kind for good; other instances start without one
    instances = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        scored = edges.select("pattern", "instance", "n").distinct().join(instances, "instance")
        sure = scored.where(F.col("score") >= CONFIDENT).groupBy("pattern").agg(F.count_distinct("instance").alias("sure")).where(f"sure >= {SEEDS}")
        sums = scored.groupBy("pattern", "n", "kind").agg(F.sum("score").alias("sum")).join(sure, "pattern", "left_semi")
        patterns = stored(sums.select("pattern", "kind", (F.col("sum") / (F.col("n") + PRIOR)).alias("confidence")))
        joint = edges.where("kind is null").select("pattern", "instance").join(patterns, "pattern").groupBy("instance", "kind")
        spread = joint.agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
        seeds = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
        instances = seeds.unionByName(spread.select("instance", "kind", "score")).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    best = patterns.where(F.col("confidence") >= CONFIDENT).groupBy("pattern").agg(_best().alias("b"))
    return best.select("pattern", "b.kind", "b.confidence")


def _best() -> Column:
    """Of a group, the struct of greatest confidence, then of the kind listed first."""
    order = -F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    return F.max(F.struct("confidence", order.alias("order"), "kind"))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, base and spans (base and discovered, by start, then kind) of every row.

    Rows without a candidate take no part in the join of places and patterns."""
    rows = stored(extract(docs, without(keep, ("base", "spans")), text))
    confident = score_graph(rows)
    some = F.exists("__places", lambda p: p["kind"].isNull())
    places = rows.where(some).select("__key", F.explode("__places").alias("p")).where("p.kind is null").select("__key", "p.start", "p.end", F.explode("p.patterns").alias("pattern")).distinct()
    hits = places.join(confident, "pattern").groupBy("__key", "start", "end").agg(_best().alias("b"))
    found = hits.groupBy("__key").agg(F.collect_set(F.struct("start", "end", F.col("b.kind").alias("kind"))).alias("__found")).withColumn("__found", apart(F.col("__found")))
    joined = rows.where(some).drop("__places").join(found, "__key", "left")
    spans = F.concat("base", F.coalesce("__found", F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")))
    joined = joined.withColumn("spans", in_order(spans)).drop("__found", "__key")
    return joined.unionByName(rows.where(~some).withColumn("spans", F.col("base")).drop("__places", "__key"))


def apart(spans: Column) -> Column:
    """The longest spans first, then the leftmost, without those that overlap one already taken."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    return F.aggregate(plain, none, lambda out, s: F.when(F.exists(out, lambda o: meets(o, s)), out).otherwise(F.concat(out, F.array(s))))


def in_order(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, ALL_KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """docs' `columns`, with every span of the text replaced by its kind in angle brackets; null stays null.

    Overlapping spans are replaced as one, under the kind of the first."""
    held = docs.select(F.struct(*columns).alias("__row"), F.col(text).alias("__text_copy"))
    rows = find(held, ["__row"], "__text_copy").select("__row.*", F.col("spans").alias("__spans"))
    schema = docs.select(*columns).schema
    at = columns.index(text)

    def replaced(batches):
        working("pii")
        for batch in batches:
            texts = []
            for value, spans in zip(batch.column(at).to_pylist(), batch.column("__spans").to_pylist()):
                if spans:
                    out, done = [], 0
                    for s in spans:
                        if s["start"] >= done:
                            out += [value[done : s["start"]], f"<{s['kind']}>"]
                        done = max(done, s["end"])
                    value = "".join(out) + value[done:]
                texts.append(value)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return rows.mapInArrow(replaced, schema)

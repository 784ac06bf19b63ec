"""Operator 8, benchmark decontamination with a distributed positional inverted index.

The index holds the postings of all terms of the training texts and does not depend on a benchmark.  It is parted by
document: a shard of texts is one row with its terms in order and, term by term, their positions, so a search needs no
shuffle and a lost shard is searched again by itself.  A search takes the benchmark in blocks of a bounded number of
words, sums the corpus counts of the block's terms from the index, and for each window of the benchmark starts from the
postings of its rarest term and keeps the places where the next rarer terms follow at their offsets, so that most are
gone after one step.  Proximity matches start from the rarest and from the second rarest term, so one edited word is no
escape.

Defined results: null, empty and wordless texts have no words, no hits; an item without words has no window, a null item
id counts as empty text; equal windows of several items all count; repeated documents and those without an id each get
their own row; texts of any length are indexed whole; an empty table of documents gives no rows, an empty benchmark no
hits; a kept column may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, without, words_of, working

WINDOW = 13
#: Words of a block of the benchmark: what is sent to the executors at once.
BLOCK_WORDS = 250_000
#: Bytes of text of a shard, about.
SHARD = 8_000_000
#: Words that a term of a proximity match may be out of place, and the rarest terms of a window that are looked for.
SLOP, RAREST = 2, 5
#: Bytes of matches that are broadcast to the documents; more are joined by a shuffle.
BROADCAST = 64_000_000
#: Between documents of a shard; no window reaches over it.
_GAP = 64
_WIDTH = 1 << 40
NEW = ("n_words", "hit", "items", "near", "n_near")


class Block:
    """Benchmark items as term numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = [name for name, _ in items]
        words = list(chain.from_iterable(w for _, w in items))
        self.terms = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.ids = np.array([self.terms[w] for w in words], np.int32)
        self.ends = np.cumsum([len(w) for _, w in items])
        self.counts = np.zeros(len(self.terms), np.int64)

    def windows(self):
        """(item, size, terms, offsets) of windows of one size, each window's terms from the rarest on."""
        by_size: dict[int, tuple[list, list]] = {}
        for item, ids in enumerate(np.split(self.ids, self.ends[:-1]) if self.names else []):
            if ids.size:
                size = min(WINDOW, ids.size)
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                owner, some = by_size.setdefault(size, ([], []))
                owner.append(np.full(len(rows), item))
                some.append(rows)
        for size, (owner, some) in by_size.items():
            rows = np.concatenate(some)
            order = np.argsort(self.counts[rows], axis=1, kind="stable")
            yield np.concatenate(owner), size, np.take_along_axis(rows, order, 1).astype(np.int64), order


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_WORDS):
    """The benchmark's items, in blocks of about `most` words, one at a time."""
    items, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    for row in rows.toLocalIterator():
        items.append((row["item"], words_of((row["text"] or "").encode())))
        n += len(items[-1][1])
        if n >= most:
            yield Block(items)
            items, n = [], 0
    if items:
        yield Block(items)


def _packed(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def _inverted(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, where the postings of each end, the postings, and the number of words of each text."""
    lists = [words_of(t) for t in texts]
    n = np.array([len(w) for w in lists], np.int64)
    words = list(chain.from_iterable(lists))
    terms = sorted(set(words))
    number = {w: i for i, w in enumerate(terms)}
    ids = np.array(list(map(number.__getitem__, words)), np.int32)
    base = _GAP + np.cumsum(n + _GAP) - (n + _GAP)
    position = np.arange(ids.size) + np.repeat(base - (np.cumsum(n) - n), n)
    order = np.argsort(ids, kind="stable")
    return terms, np.cumsum(np.bincount(ids, minlength=len(terms))), position[order], n


def index_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows of documents (`keep`, n_words, __shard, __at) and rows of shards (__shard, and __terms, one a line, __ends,
    __postings and the documents' __sizes as packed integers); each kind leaves the other's columns null."""
    keep = without(keep, NEW)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__text"), *keep)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema.fields]
    packed = "__terms binary, __ends binary, __postings binary, __sizes binary"
    names = [*rows.columns[1:], "n_words", "__shard", "__at", "__terms", "__ends", "__postings", "__sizes"]

    def indexed(batches):
        working("decontaminate")
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARD, "right")) - at)
                part = batch.slice(at, n)
                at += n
                terms, ends, postings, n_words = _inverted(part.column(0).to_pylist())
                shard += 1
                none = [pa.nulls(n, pa.binary())] * 4
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n_words), pa.array(np.full(n, shard)), pa.array(np.arange(n)), *none], names=names)
                one = [pa.array([x], pa.binary()) for x in (b"\n".join(terms), _packed(ends), _packed(postings), _packed(n_words))]
                none = [pa.nulls(1, c.type) for c in part.columns[1:]]
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.int64()), pa.array([shard]), pa.nulls(1, pa.int64()), *one], names=names)

    return rows.mapInArrow(indexed, ", ".join([*kept, "n_words bigint, __shard bigint, __at bigint", packed]))


def _shards(index: DataFrame, *columns: str) -> DataFrame:
    return index.where("__terms is not null").select(*columns)


def _wanted(terms: dict[bytes, int], shard_terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which terms of a shard the block has, and their numbers in it."""
    numbers = np.array([terms.get(t, -1) for t in shard_terms], np.int64)
    at = np.flatnonzero(numbers >= 0)
    return at, numbers[at]


def term_counts(index: DataFrame, block: Block) -> np.ndarray:
    """How often each of the block's terms occurs in all documents, summed up from the index."""
    shared = index.sparkSession.sparkContext.broadcast(block.terms)
    size = len(block.terms)

    def counted(batches):
        working("decontaminate")
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, ends in zip(*(c.to_pylist() for c in batch.columns)):
                at, which = _wanted(shared.value, terms.split(b"\n"))
                total[which] += np.diff(_unpacked(ends), prepend=0)[at] if at.size else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in _shards(index, "__terms", "__ends").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class Postings:
    """Postings of a block's terms in one shard, as one sorted list of (term, position)."""

    def __init__(self, terms: dict[bytes, int], shard_terms: list[bytes], ends: np.ndarray, postings: np.ndarray, sizes: np.ndarray):
        at, which = _wanted(terms, shard_terms)
        begin = np.concatenate(([0], ends))
        lists = [int(k) * _WIDTH + postings[begin[i] : begin[i + 1]] for i, k in zip(at, which)]
        self.keys = np.sort(np.concatenate(lists)) if lists else np.empty(0, np.int64)
        self.first = np.searchsorted(self.keys, np.arange(len(terms) + 1) * _WIDTH)
        self.base = _GAP + np.cumsum(sizes + _GAP) - (sizes + _GAP)

    def starts(self, term: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows whose term lies at an offset: (window, where it would start) of each posting of the term."""
        n = self.first[term + 1] - self.first[term]
        which = np.repeat(np.arange(term.size), n)
        at = self.first[term][which] + np.arange(which.size) - (np.cumsum(n) - n)[which]
        return which, self.keys[at] - term[which] * _WIDTH - offset[which]

    def there(self, term: np.ndarray, position: np.ndarray, slop: int = 0) -> np.ndarray:
        """Whether the term has a posting no further than slop from the position."""
        key = term * _WIDTH + position
        at = np.searchsorted(self.keys, key - slop)
        return (at < self.keys.size) & (self.keys[np.minimum(at, self.keys.size - 1)] <= key + slop)

    def exact(self, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence, from the rarest term on."""
        which, start = self.starts(terms[:, 0], offsets[:, 0])
        for k in range(1, terms.shape[1]):
            if not which.size:
                break
            ok = self.there(terms[which, k], start + offsets[which, k])
            which, start = which[ok], start[ok]
        return which, start

    def near(self, terms: np.ndarray, offsets: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) of every place where the rarest terms but one, or all if they are three or fewer,
        lie within slop of their offsets, as counted from the rarest or the second rarest."""
        some = min(RAREST, terms.shape[1])
        miss = 1 if some > 3 else 0
        out = []
        for pivot in range(min(1 + miss, some)):
            which, start = self.starts(terms[:, pivot], offsets[:, pivot])
            missed = np.zeros(which.size, np.int64)
            for k in range(some):
                if k != pivot and which.size:
                    missed += ~self.there(terms[which, k], start + offsets[which, k], slop)
                    ok = missed <= miss
                    which, start, missed = which[ok], start[ok], missed[ok]
            out.append((which, start, self.document(start + offsets[which, pivot])))
        return tuple(np.concatenate(x) for x in zip(*out))

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, position, "right") - 1


_HIT, _NEAR = "array<struct<start: bigint, end: bigint>>", "array<struct<item: string, start: bigint, end: bigint>>"


def search(index: DataFrame, block: Block, slop: int = SLOP) -> DataFrame:
    """(__shard, __at, hit, items, near) of the documents with exact or proximity matches.

    hit has the word ranges of exact matches, items their ids, near the ids and word ranges of both kinds."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    close = pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def searched(batches):
        working("decontaminate")
        block = shared.value
        windows = list(block.windows())
        for batch in batches:
            for shard, terms, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                ends, at, sizes = map(_unpacked, packed)
                postings = Postings(block.terms, terms.split(b"\n"), ends, at, sizes)
                hits: dict[int, set] = {}
                near: dict[int, set] = {}
                for owner, size, some, offsets in windows:
                    which, start = postings.exact(some, offsets)
                    doc = postings.document(start)
                    for d, i, s in zip(doc.tolist(), owner[which].tolist(), (start - postings.base[doc]).tolist()):
                        hits.setdefault(d, set()).add((s, s + size, block.names[i]))
                    which, start, doc = postings.near(some, offsets, slop)
                    start = start - postings.base[doc]
                    for d, i, a, b in zip(doc.tolist(), owner[which].tolist(), np.maximum(start, 0).tolist(), np.minimum(start + size, sizes[doc]).tolist()):
                        near.setdefault(d, set()).add((block.names[i], a, b))
                docs = sorted(hits.keys() | near.keys())
                cols = [
                    pa.array([shard] * len(docs), pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array([merged((a, b) for a, b, _ in hits.get(d, ())) for d in docs], pa.list_(pair)),
                    pa.array([sorted({i for _, _, i in hits.get(d, ())}) for d in docs], pa.list_(pa.string())),
                    pa.array([[{"item": i, "start": a, "end": b} for i, a, b in sorted(near.get(d, ()))] for d in docs], pa.list_(close)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["__shard", "__at", "hit", "items", "near"])

    rows = _shards(index, "__shard", "__terms", "__ends", "__postings", "__sizes")
    return rows.mapInArrow(searched, f"__shard bigint, __at bigint, hit {_HIT}, items array<string>, near {_NEAR}")


def merged(spans) -> list[dict]:
    """Union of spans, in order."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`keep`, n_words, hit, items, near and n_near (items in near) of every document, against the whole benchmark."""
    index = stored(index_documents(docs, keep, text))
    found = None
    for block in blocks_of(benchmark, most=block_words):
        block.counts = term_counts(index, block)
        some = stored(search(index, block, slop))
        found = found.unionByName(some) if found is not None else some
    rows = index.where("__terms is null").select(*index.columns[:-4])
    if found is None:
        found = rows.limit(0).select("__shard", "__at", F.array().cast(_HIT).alias("hit"), F.array().cast("array<string>").alias("items"), F.array().cast(_NEAR).alias("near"))
    together = found.groupBy("__shard", "__at").agg(
        F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    together = stored(together)
    size = together.agg(F.sum(100 + 40 * F.size("hit") + 60 * F.size("items") + 100 * F.size("near"))).first()[0] or 0
    joined = rows.join(F.broadcast(together) if size <= BROADCAST else together, ["__shard", "__at"], "left").drop("__shard", "__at")
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("hit", _HIT), ("items", "array<string>"), ("near", _NEAR))}
    return joined.withColumns(empty).withColumn("n_near", F.size(F.array_distinct("near.item")).cast("long"))


def n_hit(hit: str = "hit"):
    """Words in the union of a document's sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n")
    )
    return F.aggregate(hit, start, step, lambda acc: acc["n"])


def items_digest(ids: list[str]) -> str:
    return sha256(",".join(sorted(ids)).encode()).hexdigest()

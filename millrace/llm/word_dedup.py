"""Operator 13, removal of repeated word sequences behind a count-min prefilter.

A word goes if a window of WINDOW words that covers it also starts earlier: in a document of smaller id, or earlier in the
same one.  Three passes:

1. Every window is counted by its anchor, its least-hashed run of ANCHOR words: equal windows have equal anchors at equal
   places, so an anchor occurs at least as often as each of its windows, and there are about six times fewer anchors than
   windows.  Each block of a partition makes a count-min sketch of ROWS rows, sent as the touched cells of each shard of a
   row; Spark merges shards (sums, of which only "twice or more" matters) and a bit for each cell is broadcast.
   The cells are eight times as many as anchors are expected, at most MOST_CELLS a row, so the broadcast is bounded; where a
   corpus outgrows that, more windows are estimated as repeated and the second pass grows, but none is lost.
2. Windows whose anchor has a count of two or more in all rows are estimated as repeated.  A block settles repetitions
   among its own documents: of each window, all but the first go, and the first alone is shuffled (combining on the map
   side: a window that a third of all documents hold is one row a block).  Spark groups what is left by the window's 128-bit
   hash and ranks it by id and place; all but the first go.
3. The places found are gathered by document and meet the texts, by broadcast if they are small, else by a join.

Equal 128-bit hashes of windows (of two 64-bit hashes a word) count as equal windows; nothing else is estimated in the
result.  A worker holds the words of one block (about BLOCK words, or one text) and the sketch.

Defined results: null counts as empty; texts of fewer than WINDOW words keep all words; of equal texts with different ids
the one of least id is the first; a null id is smaller than all others; rows that repeat id and text are one document and
get equal results, rows that repeat an id with other texts are in the order of the texts' hashes; texts of any length are
taken whole; the empty table gives no rows; a kept column may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, without

WINDOW, ANCHOR = 20, 10
#: Rows of the sketch; most cells of a row; cells of a shard.
ROWS, MOST_CELLS, SHARD = 2, 1 << 30, 1 << 22
#: Words that a worker takes at once; distinct words whose hashes it remembers.
BLOCK, VOCABULARY = 1_000_000, 300_000
#: Found places that are broadcast at most, in bytes as stored.
BROADCAST = 16 << 20
_BASES = tuple(int(b) for b in np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64))


class _Vocabulary(dict):
    """Numbers of words, with two hashes each."""

    def __init__(self):
        super().__init__()
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.digests)
        self.digests.append(xxhash.xxh3_128_digest(word))
        return n

    def hashes(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _first_least(values: np.ndarray, length: int) -> np.ndarray:
    """Of each run of a length, the place of its first least value; without a copy of all runs."""
    n = len(values) - length + 1
    least, place = values[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, length):
        less = values[j : j + n] < least
        np.copyto(least, values[j : j + n], where=less)
        place[less] = j
    return place


class _Hashes:
    """Hashes of the sequences of a length that start at each word, by differences of running sums modulo 2^64."""

    def __init__(self):
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, values: np.ndarray, length: int, which: int) -> np.ndarray:
        n = len(values) + 1
        if not self.tables or len(self.tables[0][0]) < n:
            self.tables = [(_powers(b, n), _powers(pow(b, -1, 1 << 64), n)) for b in _BASES]
        up, down = self.tables[which]
        sums = np.zeros(n, np.uint64)
        np.cumsum(values * up[: n - 1], out=sums[1:])
        return (sums[length:] - sums[:-length]) * down[: n - length]


class _Block:
    """Words of some texts of WINDOW words or more, one after the other, and the windows within them."""

    def __init__(self, texts: list[np.ndarray], digests: np.ndarray, hashes: _Hashes):
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = sizes - WINDOW + 1
        self.words, self._hashes = digests[np.concatenate(texts)], hashes
        self.text = np.repeat(np.arange(len(texts)), windows)
        #: Start of each window: within its text, and among all words.
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = self.start + np.repeat(np.cumsum(sizes) - sizes, windows)
        runs = _mixed(hashes.of(self.words[:, 0], ANCHOR, 0))
        self.place = self.at + _first_least(runs, WINDOW - ANCHOR + 1)[self.at]
        self.anchor = runs[self.place]

    def anchors(self) -> np.ndarray:
        """Hash of each anchor, once for each place that it is at."""
        new = np.ones(len(self.place), bool)
        new[1:] = self.place[1:] != self.place[:-1]
        return self.anchor[new]

    def windows(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the windows chosen."""
        return tuple(_mixed(self._hashes.of(self.words[:, k], WINDOW, k + 1)[self.at[among]]) for k in (0, 1))


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [(_mixed(anchors + np.uint64(k * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(ROWS)]


def _blocks(batches):
    """Of each block of rows whose texts (the last column) have WINDOW words or more: the other columns of each row, the
    numbers of its words, and the hashes of the words by number."""
    vocabulary, rows, texts, size = _Vocabulary(), [], [], 0
    for batch in batches:
        *others, column = batch.columns
        for row, text in zip(zip(*(c.to_pylist() for c in others)) if others else repeat(()), column):  # one text at a time
            words = (text.as_py() or "").encode().split()
            if len(words) < WINDOW:
                continue
            rows.append(row)
            texts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= BLOCK:
                yield rows, texts, vocabulary.hashes()
                rows, texts, size = [], [], 0
                if len(vocabulary) > VOCABULARY:
                    vocabulary = _Vocabulary()
    if rows:
        yield rows, texts, vocabulary.hashes()


def cells_for(docs: DataFrame, text: str = "text") -> int:
    """Bits of a cell's number: eight cells for each anchor expected, at most MOST_CELLS."""
    letters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    anchors = letters / 6 * 2 / (WINDOW - ANCHOR + 2)
    return int(np.clip(np.ceil(np.log2(max(1, 8 * anchors))), 16, np.log2(MOST_CELLS)))


def sketch(docs: DataFrame, bits: int, text: str = "text") -> list[np.ndarray]:
    """For each row of the sketch a bit for each cell: whether anchors were counted in it twice or more."""
    shard = min(SHARD, 1 << bits)
    per_row = (1 << bits) // shard

    def counted(batches):
        hashes = _Hashes()
        for _, texts, digests in _blocks(batches):
            found = _Block(texts, digests, hashes).anchors()
            out = []
            for k, cells in enumerate(_cells(found, bits)):
                touched, counts = np.unique(cells, return_counts=True)
                for s, part, times in zip(*_parts(touched, counts, shard)):
                    out.append((k * per_row + int(s), part.astype(np.uint32).tobytes(), part[times > 1].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([zlib.compress(_steps(o[i]), 1) for o in out], pa.binary()) for i in (1, 2))], names=["shard", "once", "twice"])

    def merged(batches):
        current, counts = None, None
        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if s != current:
                    if current is not None:
                        yield _shard(current, counts)
                    current, counts = s, np.zeros(shard, np.uint8)
                for cells in (once, twice):
                    at = _unsteps(zlib.decompress(cells))
                    counts[at] = np.minimum(counts[at] + 1, 2)
        if current is not None:
            yield _shard(current, counts)

    parts = docs.select(text).mapInArrow(counted, "shard long, once binary, twice binary")
    whole = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, "shard long, bits binary")
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for r in whole.collect():  # ROWS * MOST_CELLS bits at most
        k, s = divmod(r["shard"], per_row)
        rows[k][s * shard // 8 : (s + 1) * shard // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return rows


def _parts(cells: np.ndarray, counts: np.ndarray, shard: int):
    """Shards that sorted cells are in, with the cells of each, counted within the shard, and their counts."""
    owner = cells // shard
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return owner[np.concatenate([[0], cuts])] if len(owner) else [], np.split(cells % shard, cuts), np.split(counts, cuts)


def _steps(cells: bytes) -> bytes:
    """Sorted numbers as bytes of their differences, low bytes first, which compress well."""
    at = np.frombuffer(cells, np.uint32)
    return np.diff(at, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _shard(number: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["shard", "bits"])


def _key(doc_id: str, text: str) -> list:
    """__id (null: the least long), __tie (a hash of the text) and __text."""
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    return [number.alias("__id"), F.xxhash64(text).alias("__tie"), F.col(text).alias("__text")]


_FOUND = "high long, low long, id long, tie long, start int, settled binary"


def candidates(rows: DataFrame, twice: list[np.ndarray], bits: int) -> DataFrame:
    """Windows estimated as repeated, once a block, by hash, with the first place; and, with `settled` set, the starts of
    the windows of a document that a block has settled."""
    known = rows.sparkSession.sparkContext.broadcast(twice)

    def found(batches):
        hashes = _Hashes()
        for block, texts, digests in _blocks(batches):
            docs = dict(zip(block, texts))  # rows that repeat id and text are one document
            keys = sorted(docs)
            b = _Block([docs[k] for k in keys], digests, hashes)
            often = np.ones(len(b.anchor), bool)
            for cells, row in zip(_cells(b.anchor, bits), known.value):
                often &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
            among = np.flatnonzero(often)
            high, low = b.windows(among)
            order = np.lexsort((low, high))  # stable: equal windows stay in order of id, tie and place
            same = np.zeros(len(order), bool)
            same[1:] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
            first = among[order[~same]]
            ids, ties = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
            start = b.start.astype(np.int32)
            at = order[~same]
            yield _found(high[at].view(np.int64), low[at].view(np.int64), ids[b.text[first]], ties[b.text[first]], start[first], [None] * len(first))
            gone = np.sort(among[order[same]])
            cuts = np.flatnonzero(np.diff(b.text[gone])) + 1
            settled = [p for p in np.split(gone, cuts) if len(p)]
            if settled:
                owner = np.array([b.text[p[0]] for p in settled])
                places = [start[p].tobytes() for p in settled]
                hashed = _mixed(ids[owner].view(np.uint64)).view(np.int64)
                yield _found(hashed, hashed, ids[owner], ties[owner], np.zeros(len(owner), np.int32), places)

    return rows.mapInArrow(found, _FOUND)


def _found(high, low, ids, ties, starts, settled) -> pa.RecordBatch:
    cols = [pa.array(x, t) for x, t in ((high, pa.int64()), (low, pa.int64()), (ids, pa.int64()), (ties, pa.int64()), (starts, pa.int32()), (settled, pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, names=["high", "low", "id", "tie", "start", "settled"])


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tie and the starts of windows that also start earlier: `later` (an array) and `settled` (arrays of 32-bit numbers)."""
    ship(docs.sparkSession)
    bits = cells_for(docs, text)
    open_ = candidates(docs.select(*_key(doc_id, text)), sketch(docs, bits, text), bits)
    place = F.rank().over(Window.partitionBy("high", "low", F.col("settled").isNotNull()).orderBy("id", "tie", "start"))
    later = open_.withColumn("place", place).where((F.col("place") > 1) | F.col("settled").isNotNull())
    starts = F.collect_list(F.when(F.col("settled").isNull(), F.col("start")))
    return later.groupBy("id", "tie").agg(starts.alias("later"), F.collect_list("settled").alias("settled"))


def remove_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`keep`, n_words, n_removed and kept (the words that remain, joined by one space) of every row."""
    places = stored(repeated(docs, doc_id, text))
    held = F.size("later") * 4 + F.aggregate("settled", F.lit(0), lambda n, x: n + F.length(x)) + 16
    size = places.agg(F.sum(held)).first()[0] or 0
    found = places.toDF("__id", "__tie", "__later", "__settled")
    keep = without(keep, ("n_words", "n_removed", "kept"))
    kept_as = [f"__keep{i}" for i in range(len(keep))]  # whatever their names, they clash with none of ours
    rows = docs.select(*_key(doc_id, text), *[F.col(c).alias(n) for c, n in zip(keep, kept_as)])
    joined = rows.join(F.broadcast(found) if size <= BROADCAST else found, ["__id", "__tie"], "left").select("__text", "__later", "__settled", *kept_as)
    schema = joined.select(*[F.col(n).alias(c) for c, n in zip(keep, kept_as)], F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).schema

    def removed(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for t, later, settled in zip(*(batch.column(i) for i in range(3))):
                words = (t.as_py() or "").encode().split()
                stay = words
                if later.is_valid:  # null: no window of the text goes
                    edges = np.zeros(len(words) + 1, np.int32)
                    for starts in (later.values.to_numpy(zero_copy_only=False), *(np.frombuffer(s, np.int32) for s in settled.as_py())):
                        edges[starts] += 1
                        edges[starts + WINDOW] -= 1
                    stay = [w for w, c in zip(words, np.cumsum(edges).tolist()) if not c]
                n.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *new], names=[*keep, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(removed, schema)

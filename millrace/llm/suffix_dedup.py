"""Operator 4, removal of repeated byte strings with grouped suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another.  Two
equal strings of that length have the same least-hashed ANCHOR bytes at the same place, so it is enough to compare the
segments around equal anchors.  Anchors are counted over the whole corpus; only texts with an anchor that occurs twice
send the segments around it.  Segments that are equal as a whole (MD5) settle each other.

The different segments of an anchor are sorted by suffix construction, once by what follows the anchor's start and once
by what precedes it, read backwards: the text of all of them is a sequence of symbols, 64 bytes each, counted from the
anchor; groups of suffixes with equal Lyndon prefixes are taken from the highest down, each pulling its previous smaller
suffixes out of their groups, and one pass over the final groups emits the order.  The bytes that neighbours share in
the two orders decide: for each number of bytes x before the anchor, segments that share x bytes before it and LENGTH - x
from it on have the same string there, and these classes are runs of the two orders.  Each segment ends up with one
range around its anchor.

A group of more than MOST different segments does not go to one task.  It is split by ranges of x into groups that share
longer strings and need fewer bytes around them, again and again until a group fits or all its segments are equal (which
they are at the latest when one x is left, as the group then shares LENGTH bytes).  Sizes are counted on Spark.

Defined results: null counts as empty; texts shorter than LENGTH keep everything; of equal texts of LENGTH bytes or more
nothing is left, repeated rows included; texts of any length are taken whole; the empty table gives no rows; rows
without an id are rows like others; a kept column may have the name of a new one, which then takes its place.
"""

from __future__ import annotations

from hashlib import md5, sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, without

LENGTH, ANCHOR, BLOCK = 400, 128, 64
#: Most bytes of a segment before an anchor's first byte, and from it on.
LEFT, RIGHT = LENGTH - ANCHOR, LENGTH
#: Most different segments that are sorted in one task, and the parts that a larger group's range is split into.
MOST, PARTS = 16_384, 8
#: Most names of large groups (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Segments that are sorted together, of one group or several.
_BATCH = 4_000


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` elements."""
    span = 1
    while 2 * span <= width:
        a = pick(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return pick(a[: a.size - rest], a[rest:]) if rest else a


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least-hashed ANCHOR bytes of every string of LENGTH bytes."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power, width = 0x9E3779B97F4A7C15, 1
    while width < ANCHOR:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    windows = LENGTH - ANCHOR + 1
    least = _sliding(h, windows, np.minimum)
    # a position is an anchor if the least of some string around it is its own hash
    edge = np.zeros(windows - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), windows, np.maximum) == h)
    return at, h[at].view(np.int64)


def suffix_order(s: list[int]) -> list[int]:
    """Starts of the suffixes of s (numbers from 0) in ascending order, in time linear in its length and largest number.

    Phase 1 takes groups of suffixes from the highest down.  For each suffix of a group it finds the nearest earlier
    suffix in a lower group, by pointers already known, and moves these out of their own groups to just above the rest,
    those with more suffixes of this group behind them higher.  Phase 2 walks the order from the front: the suffix
    before one that is placed comes next in its group, and so do its previous smaller ones."""
    n = len(s)
    sizes = [0] * (max(s, default=0) + 2)
    for c in s:
        sizes[c + 1] += 1
    for c in range(1, len(sizes)):
        sizes[c] += sizes[c - 1]
    start, end = [sizes[c] for c in s], [0] * (n + 1)
    order, place, free = [0] * n, [0] * n, sizes[:]
    for p, c in enumerate(s):
        place[p] = free[c]
        order[free[c]] = p
        free[c] += 1
    for c in range(len(sizes) - 1):
        end[sizes[c]] = sizes[c + 1]
    before = [-1] * n
    at = n
    while at > 0:
        first = start[order[at - 1]]
        group = order[first:at]
        for p in group:
            q = p - 1
            while q >= 0 and start[q] > first:
                q = before[q]
            before[p] = q
        behind: dict[int, int] = {}
        for p in group:
            q = before[p]
            if q >= 0 and start[q] == first:  # a member of this group: go on to the end of the chain, and remember it
                chain = [p]
                while q >= 0 and start[q] == first:
                    chain.append(q)
                    q = before[q]
                for x in chain:
                    before[x] = q
            if q >= 0:
                behind[q] = behind.get(q, 0) + 1
        by_count: list[list[int]] = [[] for _ in range(max(behind.values(), default=0) + 1)]
        for q, k in behind.items():
            by_count[k].append(q)
        for some in reversed(by_count):
            by_group: dict[int, list[int]] = {}
            for q in some:
                by_group.setdefault(start[q], []).append(q)
            for g, moved in by_group.items():
                stop = end[g]
                if len(moved) == stop - g:
                    continue
                to = stop
                for q in moved:
                    to -= 1
                    other, old = order[to], place[q]
                    order[old], order[to] = other, q
                    place[other], place[q] = old, to
                for q in moved:
                    start[q] = to
                end[g], end[to] = to, stop
        at = first
    # phase 2; the empty suffix at n comes before all others
    filled = [0] * (n + 1)
    out, placed = [-1] * n, [False] * n
    i, p = -1, n - 1
    while True:
        while p >= 0 and not placed[p]:
            g = start[p]
            out[g + filled[g]] = p
            filled[g] += 1
            placed[p] = True
            p = before[p]
        i += 1
        if i >= n:
            return out
        p = out[i] - 1


def sorted_strings(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their groups, and how many bytes each shares with the one before it there.

    Strings have LENGTH bytes at most; the first of a group shares -1."""
    blocks = [[t[i : i + BLOCK] for i in range(0, len(t), BLOCK)] for t in strings]
    ranks = {b: i + len(strings) for i, b in enumerate(sorted({b for bs in blocks for b in bs}))}
    text, begin = [], []
    for i, bs in enumerate(blocks):
        begin.append(len(text))
        text += [ranks[b] for b in bs]
        text.append(i)  # every string ends in a symbol of its own, below all blocks
    rank = np.empty(len(text), np.int64)
    rank[suffix_order(text)] = np.arange(len(text))
    order = np.lexsort((rank[begin], group))
    shared = np.full(order.size, -1, np.int64)
    for at in range(1, order.size, 2_000):
        rows = order[at - 1 : at + 2_000]
        table = np.zeros((rows.size, LENGTH + 1), np.uint8)
        sizes = np.array([len(strings[i]) for i in rows])
        for row, i, n in zip(table, rows, sizes):
            row[:n] = np.frombuffer(strings[i], np.uint8)
        differ = table[1:] != table[:-1]
        differ[:, -1] = True
        shared[at : at + rows.size - 1] = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def ranges(segments: list[tuple[bytes, int]], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (bytes, anchor's place): how far strings that another segment of its group has reach left and right.

    Both count from the anchor's first byte; 0 and 0 if there is none. Group numbers ascend."""
    right, r_shared = sorted_strings([data[at:] for data, at in segments], group)
    left, l_shared = sorted_strings([data[:at][::-1] for data, at in segments], group)
    n = len(segments)
    reach, back = np.zeros(n, np.int64), np.full(n, LENGTH, np.int64)
    # those that share too little with any other need no look
    most = np.zeros(n, np.int64)
    for order, shared in ((right, r_shared), (left, l_shared)):
        most[order] += np.maximum(np.maximum(shared, np.append(shared[1:], -1)), 0)
    some = np.flatnonzero(most >= LENGTH)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(LEFT + 1) if some.size else ():
        r_class[right] = np.cumsum(r_shared < LENGTH - x)
        l_class[left] = np.cumsum(l_shared < x)
        both = r_class[some] * (n + 1) + l_class[some]
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        hit = np.zeros(some.size, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = some[hit]
        reach[at] = x
        back[at] = np.minimum(back[at], x)
    return reach, LENGTH - back


def _sorted_groups(batches):
    """(group, rest, off, seg), sorted by the first two, to (group, rest, left, right)."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def found(groups):
        flat = [r for g in groups for r in g]
        number = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        left, right = ranges([(r[3], r[2]) for r in flat], number)
        at = np.flatnonzero(right)
        cols = [pa.array([flat[i][k] for i in at], pa.binary()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(left[at]), pa.array(right[at])], ["group", "rest", "left", "right"])

    waiting, size = [], 0
    for _, group in groupby(rows(), key=lambda r: r[0]):
        group = [next(same) for _, same in groupby(group, key=lambda r: r[1])]
        if len(group) > 1:
            waiting.append(group)
            size += len(group)
            if size >= _BATCH:
                yield found(waiting)
                waiting, size = [], 0
    if waiting:
        yield found(waiting)


def _anchor_rows(batches):
    for batch in batches:
        keys, hashes, often = [], [], []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, n = np.unique(anchors(data)[1], return_counts=True)
            keys += [key] * h.size
            hashes.append(h)
            often.append(n > 1)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(often))], ["key", "anchor", "often"])


_SEGMENTS = "group binary, rest binary, key binary, off long, size long, seg binary, starts array<long>"
_RESTS = "group binary, rest binary, key binary, of binary, low long, high long, off long, size long, seg binary"


def _segment_rows(batches):
    """Each text's segments around the wanted anchors, equal ones once with all their starts.

    The bytes come with the first of equal segments of a task only."""
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = ["group", "rest", "key", "off", "size", "seg", "starts"]
    sent: set[bytes] = set()
    for batch in batches:
        for key, data, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            at, hashes = anchors(data)
            wanted = np.isin(hashes, np.array(wanted, np.int64))
            starts: dict[tuple, list[int]] = {}
            for p, h in zip(at[wanted].tolist(), hashes[wanted].tolist()):
                a = max(0, p - LEFT)
                starts.setdefault((h, p - a, data[a : p + RIGHT]), []).append(a)
            rows = []
            for (h, off, seg), s in starts.items():
                group = h.to_bytes(8, "big", signed=True)
                rest = md5(group + b"%d:" % off + seg).digest()
                rows.append((group, rest, key, off, len(seg), None if rest in sent else seg, s))
                if len(sent) > 500_000:
                    sent.clear()
                sent.add(rest)
            for i in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2_000]), kinds)], names)


def _split_rows(parts):
    """Rows of large groups, (group, rest, key, low, high, off, seg), to rows of groups that share longer strings."""
    kinds = [pa.binary()] * 4 + [pa.int64()] * 4 + [pa.binary()]
    names = ["group", "rest", "key", "of", "low", "high", "off", "size", "seg"]

    def split(batches):
        for batch in batches:
            rows = []
            for group, rest, key, low, high, off, seg in zip(*(c.to_pylist() for c in batch.columns)):
                step = -(-(high - low + 1) // parts)
                for a in range(low, high + 1, step):
                    b = min(a + step - 1, high)  # strings that start a to b bytes before the anchor
                    if off < a or len(seg) - off < LENGTH - b:
                        continue
                    begin, stop = off - min(off, b), off + min(len(seg) - off, LENGTH - a)
                    if stop - begin < LENGTH:
                        continue
                    name = md5(group + b"%d:%d:" % (a, b) + seg[off - a : off + LENGTH - b]).digest()
                    part = seg[begin:stop]
                    rows.append((name, md5(b"%d:" % (off - begin) + part).digest(), rest, group, a, b, off - begin, len(part), part))
            for i in range(0, len(rows), 2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2_000]), kinds)], names)

    return split


def _settled(rows: DataFrame, counted, most: int, parts: int, low: str, high: str) -> DataFrame:
    """(group, rest, left, right) of the segments in rows (group, rest, off, size, seg) that share strings."""
    n = stored(rows.groupBy("group", "rest").agg(counted.alias("n"), F.first("off").alias("off"), F.first("size").alias("size")))
    kinds = n.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = n.where("n > 1").select("group", "rest", F.col("off").alias("left"), (F.col("size") - F.col("off")).alias("right"))
    bytes_ = rows.where("seg is not null")
    large = stored(kinds.where(F.col("kinds") > most).select("group"))
    n_large = large.count()
    few = F.broadcast(large) if n_large <= BROADCAST else large  # so that a large group's rows are not dealt to one task
    small = bytes_.join(few, "group", "left_anti") if n_large else bytes_
    some = small.join(kinds.where(F.col("kinds") <= most).select("group"), "group", "left_semi")
    sorted_ = some.select("group", "rest", "off", "seg").repartition("group").sortWithinPartitions("group", "rest")
    found = stored(whole.unionByName(sorted_.mapInArrow(_sorted_groups, "group binary, rest binary, left long, right long")))
    if not n_large:
        dropped(n, large)
        return found
    many = bytes_.join(few, "group", "left_semi").dropDuplicates(["group", "rest"])
    many = many.select("group", "rest", F.lit(b"").alias("key"), F.expr(low).cast("long").alias("low"), F.expr(high).cast("long").alias("high"), "off", "seg")
    finer = stored(many.mapInArrow(_split_rows(parts), _RESTS))
    deeper = _settled(finer, F.count("*"), most, parts, "low", "high")
    back = finer.select("group", "rest", F.col("of").alias("__of"), F.col("key").alias("__rest")).join(deeper, ["group", "rest"])
    back = stored(back.groupBy("__of", "__rest").agg(F.max("left").alias("left"), F.max("right").alias("right")))
    dropped(n, finer, large)
    return found.unionByName(back.select(F.col("__of").alias("group"), F.col("__rest").alias("rest"), "left", "right"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found) of every text with repeated strings: key is the MD5 of the text, found an array of (starts of
    segments, place of the anchor in them, bytes covered before and after it)."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.col(doc_id).alias("doc_id"), data.alias("data")).where(F.length("data") >= LENGTH).withColumn("key", F.unhex(F.md5("data")))
    copies = stored(texts.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.max(F.length("data")).cast("long").alias("size")))
    found = stored(texts.select("key", "data").mapInArrow(_anchor_rows, "key binary, anchor long, often boolean"))
    mark = F.xxhash64("key")
    often = found.groupBy("anchor").agg(F.min(mark).alias("x"), F.max(mark).alias("y"), F.max("often").alias("often")).where("x != y or often").select("anchor")
    # copies of a text need no look inside: nothing of them stays; one of them stands for all as a partner
    wanted = found.select("key", "anchor").distinct().join(often, "anchor", "left_semi").groupBy("key").agg(F.collect_list("anchor").alias("anchors")).join(copies.select("key", "doc_id"), "key")
    on = (texts["key"] == wanted["key"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    one = texts.join(wanted, on).select(wanted["key"], wanted["doc_id"], "data", "anchors").dropDuplicates(["key", "doc_id"])
    segments = stored(one.select("key", "data", "anchors").mapInArrow(_segment_rows, _SEGMENTS))
    dropped(found)
    settled = _settled(segments, F.sum(F.size("starts")), MOST, PARTS, "0", f"{LEFT}")
    settled = settled.groupBy("group", "rest").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    hits = segments.select("group", "rest", "key", "off", "starts").join(settled, ["group", "rest"])
    by_text = hits.groupBy("key").agg(F.collect_list(F.struct("starts", "off", "left", "right")).alias("found"))
    zero = F.lit(0).cast("long")
    equal = copies.where("n > 1").select("key", F.array(F.struct(F.array(zero).alias("starts"), zero.alias("off"), zero.alias("left"), F.col("size").alias("right"))).alias("found"))
    out = stored(by_text.join(equal.select("key"), "key", "left_anti").unionByName(equal))
    dropped(segments, copies)
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """`keep`, n_bytes, n_removed, n_spans, kept_sha256, has_repeats (whether anything went) and, if wanted, kept (the
    remaining bytes) of every row. Rows too short to hold a repeated string take no part in the join."""
    spans = repeated_spans(docs, doc_id, text).select(F.col("key").alias("__key"), F.col("found").alias("__found"))
    new = {"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit(""), "has_repeats": F.lit(False)}
    new |= {"kept": F.lit(b"")} if with_kept else {}
    keep, names = without(keep, new), list(new)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__data"), *keep)
    long = rows.where(F.length("__data") >= LENGTH).withColumn("__key", F.unhex(F.md5("__data"))).join(spans, "__key", "left").select("__data", "__found", *keep)
    short = rows.where(F.length("__data") < LENGTH).withColumn("__found", F.lit(None).cast(spans.schema["__found"].dataType)).select("__data", "__found", *keep)
    schema = rows.drop("__data").withColumns(new).schema

    def removed(batches):
        for batch in batches:
            n, gone, runs, digests, rest = [], [], [], [], []
            for data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                merged = union([(s + f["off"] - f["left"], s + f["off"] + f["right"]) for f in found or [] for s in f["starts"]])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                n.append(len(data))
                gone.append(len(data) - len(kept))
                runs.append(len(merged))
                digests.append(sha256(kept).hexdigest())
                rest.append(kept)
            cols = [*(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digests, pa.string()), pa.array([x > 0 for x in runs], pa.bool_())]
            cols += [pa.array(rest, pa.binary())] if with_kept else []
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *cols], names=[*batch.schema.names[2:], *names])

    return long.unionByName(short).mapInArrow(removed, schema)

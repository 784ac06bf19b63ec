"""Operator 5, byte-pair encoding by a compiled automaton.

The merges of a tokenizer are compiled, in order, into a deterministic automaton whose arcs are tokens: it accepts a
sequence of tokens exactly if byte-pair encoding gives that sequence.  It starts as one state with an arc for every
symbol.  The gadget of a merge a + b = ab adds arcs labelled ab that lead where arcs labelled b led, and lets the arcs
labelled a lead to a new state, a copy of their old one without the arc b (and, later on, without what is built on b).
Tokens are numbered so that all tokens built on b after a given merge are neighbours, hence a gadget cuts one range of
numbers; a state is kept as the sorted bounds of the ranges it lacks, all states in one array.

Pre-split words are walked symbol by symbol through a trie of all tokens with failure links: it gives the tokens that
end at a place, the longest first, and exactly one of them has an arc from the state in which it starts.  Decoding
emits the labels of the arcs that the ids name.

Defined results: null counts as empty; empty texts have no token; equal texts get equal rows and repeated rows stay;
texts of any length are encoded whole; the empty table gives no rows; a kept column may have the name of a new one,
which then takes its place.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without, working

#: Chunks kept with their encoding in each Python worker.
_CACHE = 200_000
#: Words of more symbols are walked one by one, shorter ones side by side.
_LONG = 96
#: str.split takes these as white space, the splitter's pattern does not.
_CONTROL = re.compile(r"[\x1c-\x1f]").search


#: Where Unicode 16 added letters and digits, and the lower case of the capitals new in 16 and 17. The
#: tokenizer library splits by the one and lowers by the other; Python's tables are older, the regex library's are newer.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113FF),
    (0x116D0, 0x116FF), (0x11BC0, 0x11BFF), (0x13460, 0x143FF), (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF),
)
LOWER_NEW = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


@cache
def _newer():
    """Letters and digits of the regex library that the tokenizer library does not know as such."""
    known = regex.compile(r"[\p{L}\p{N}]")
    ours = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    newer = [c for c in range(0x80, 0x110000) if c not in ours and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    first = [c for c, before in zip(newer, [-2, *newer]) if c != before + 1]
    last = [c for c, after in zip(newer, [*newer[1:], -2]) if c != after - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last)) + "]")


_CAPITALS_NEW = re.compile("[" + "".join(map(chr, LOWER_NEW)) + "]")


def latin(text: str) -> bool:
    """Whether all code points are below 256, where all Unicode versions agree."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tables compiled from ordered merges. A symbol is a byte, or 256 more than it at the end of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str):
        self.labels = {i: t for t, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        if len({t for _, _, t in made}) < len(made):
            raise ValueError("two merges make the same token")
        self._number(vocab, made)
        self._compile(vocab, made)
        self._trie(vocab, word_end)

    def _number(self, vocab: dict[str, int], made: list[tuple[int, int, int]]) -> None:
        """Number tokens so that a token comes after all that are built on it, the later merges nearer to it."""
        self.kids: dict[int, list[int]] = {}
        for a, _, t in made:
            self.kids.setdefault(a, []).append(t)
        self.number, self.least = [0] * (max(vocab.values()) + 1), [0] * (max(vocab.values()) + 1)
        built, n = {t for _, _, t in made}, 0
        for root in (i for i in vocab.values() if i not in built):
            stack = [(root, 0)]
            self.least[root] = n
            while stack:
                token, at = stack.pop()
                kids = self.kids.get(token, ())
                if at < len(kids):
                    stack += [(token, at + 1), (kids[at], 0)]
                    self.least[kids[at]] = n
                else:
                    self.number[token] = n
                    n += 1

    def _compile(self, vocab: dict[str, int], made: list[tuple[int, int, int]]) -> None:
        """One gadget a merge; target is the state that arcs of a label lead to, rows the ranges that states lack."""
        rows, target = [array("I")], [0] * len(self.number)
        begun = [0] * len(self.number)  # how many of a token's kids are made
        self.never: set[int] = set()  # tokens whose halves never meet: no arc has their label
        for a, b, t in made:
            target[t] = target[b]
            if a in self.never or b in self.never or bisect_right(rows[target[a]], self.number[b]) % 2:
                self.never.add(t)
                begun[a] += 1
                continue
            kids, now = self.kids.get(b, ()), begun[b]  # in a + a = aa, aa itself counts as built later
            low = self.least[kids[now]] if now < len(kids) else self.number[b]
            high, row = self.number[b] + 1, rows[target[a]]
            i, j = bisect_right(row, low), bisect_right(row, high)
            inside = [] if i % 2 else [low]
            rows.append(row[:i] + array("I", inside + ([] if j % 2 else [high])) + row[j:])
            target[a] = len(rows) - 1
            begun[a] += 1
        # keep the states that an arc leads to, the start first
        live = [0, *sorted({target[i] for i in vocab.values()} - {0})]
        at = {s: k for k, s in enumerate(live)}
        self.target = np.array([at.get(s, 0) for s in target], np.int64)
        self.rows = [rows[s] for s in live]
        self.width = len(self.number) + 1
        self.bounds = np.concatenate([np.asarray(r, np.int64) + k * self.width for k, r in enumerate(self.rows)])
        self.numbers = np.array(self.number, np.int64)

    def _trie(self, vocab: dict[str, int], word_end: str) -> None:
        """Trie of the tokens' symbols with failure links, and for each node the longest token that ends there."""
        byte = {c: b for b, c in enumerate(byte_letters())}
        size = len(self.number)
        self.next: dict[int, int] = {}
        own, depth, parents = [-1], [0], [(0, 0)]
        self.length = np.zeros(size, np.int64)
        for token, i in vocab.items():
            if i in self.never:
                continue
            body = token.removesuffix(word_end) if len(token) > len(word_end) else token
            symbols = [byte[c] for c in body]
            if body != token:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                key = node << 9 | s
                if key not in self.next:
                    self.next[key] = len(own)
                    own.append(-1)
                    depth.append(depth[node] + 1)
                    parents.append((node, s))
                node = self.next[key]
            own[node] = i
            self.length[i] = len(symbols)
        fail, ends, shorter = [0] * len(own), [-1] * len(own), [-1] * size
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, s = parents[node]
            if parent:
                f = fail[parent]
                while f and (f << 9 | s) not in self.next:
                    f = fail[f]
                fail[node] = self.next.get(f << 9 | s, 0)
            ends[node] = own[node] if own[node] >= 0 else ends[fail[node]]
            if own[node] >= 0:
                shorter[own[node]] = ends[fail[node]]
        self.fail, self.ends, self.shorter = np.array(fail), np.array(ends), np.array(shorter)
        keys = np.array(sorted(self.next), np.int64)
        self.keys, self.nodes = keys, np.array([self.next[k] for k in keys.tolist()], np.int64)
        self.lists = (fail, ends, shorter, self.length.tolist(), self.target.tolist())

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        return bisect_right(self.rows[state], self.number[token]) % 2 == 0

    def walk(self, symbols: list[int]) -> list[int]:
        """Ids of one word, by the tables."""
        fail, ends, shorter, length, target = self.lists
        node, last, states = 0, [], [0]
        for i, s in enumerate(symbols, 1):
            while node and (node << 9 | s) not in self.next:
                node = fail[node]
            node = self.next[node << 9 | s]
            token = ends[node]
            while not self.arc(states[i - length[token]], token):
                token = shorter[token]
            last.append(token)
            states.append(target[token])
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= length[out[-1]]
        return out[::-1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words, one after another, and how many each has; words of one length step side by side."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols[starts + sizes - 1] += 256
        last = np.zeros(symbols.size, np.int64)
        far = {w: self.walk(symbols[starts[w] : starts[w] + sizes[w]].tolist()) for w in np.flatnonzero(sizes > _LONG).tolist()}
        order = np.argsort(-np.where(sizes > _LONG, 0, sizes), kind="stable")
        steps = np.where(sizes > _LONG, 0, sizes)[order]
        begin, node = starts[order], np.zeros(order.size, np.int64)
        for i in range(int(steps[0]) if steps.size else 0):
            m = int(np.searchsorted(-steps, -i))  # words of more than i symbols
            at, node = begin[:m] + i, node[:m]
            node = self._step(node, symbols[at])
            token, wait = self.ends[node], np.arange(m)
            while wait.size:
                t = token[wait]
                before = at[wait] - self.length[t]
                state = np.where(before < begin[wait], 0, self.target[last[np.maximum(before, 0)]])
                lacks = np.searchsorted(self.bounds, state * self.width + self.numbers[t], "right") & 1 == 1
                wait = wait[lacks]
                token[wait] = self.shorter[token[wait]]
            last[at] = token
        # back along the arcs
        count, rows = np.zeros(sizes.size, np.int64), []
        live, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), (starts + sizes)[(sizes > 0) & (sizes <= _LONG)]
        while live.size:
            t = last[at - 1]
            rows.append((live, t))
            count[live] += 1
            at = at - self.length[t]
            more = at > starts[live]
            live, at = live[more], at[more]
        for w, ids in far.items():
            count[w] = len(ids)
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for k, (w, t) in enumerate(rows):
            out[first[w] + count[w] - 1 - k] = t
        for w, ids in far.items():
            out[first[w] : first[w] + len(ids)] = ids
        return out, count

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, wait = np.zeros(node.size, np.int64), np.arange(node.size)
        while wait.size:
            key = node[wait] << 9 | symbol[wait]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            there = self.keys[at] == key
            out[wait[there]] = self.nodes[at[there]]
            wait = wait[~there]
            node[wait] = self.fail[node[wait]]
        return out


class WordBpe:
    """Normaliser, splitter and automaton of one tokenizer file, and the chunks between white space seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.split_lines = regex.compile(pattern + r"|\n").findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        names = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string()).cast(pa.binary())
        self._clear()

    def _clear(self) -> None:
        """Chunk k has counts[k] ids in pool from starts[k] on; special tokens are chunks with a blank before them."""
        self.pool = np.array(list(self.special.values()), np.uint32)
        self.starts, self.counts = np.arange(len(self.special)), np.ones(len(self.special), np.int64)
        self.chunks = {f" {t}": k for k, t in enumerate(self.special)}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if not latin(text) and _CAPITALS_NEW.search(text):
                text = text.translate(LOWER_NEW)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Words as the pattern parts them; code points that Python's tables do not assign are no letters."""
        if latin(text) or not _newer().search(text):
            return self.split(text)
        masked = _newer().sub("\u0378", text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(masked)]

    def parts(self, text: str) -> list[str]:
        """Chunks of a text."""
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(f" {part}")
            elif _CONTROL(part):  # str.split would cut where the pattern does not
                out += self.pieces(self.normal(part))
            else:
                out += self.normal(part).split()
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known yet; each may hold several words."""
        joined = "\n".join(chunks)
        if (latin(joined) or not _newer().search(joined)) and not _CONTROL(joined):
            found = self.split_lines(joined)
            ends = np.array([w == "\n" for w in found], bool)
            words, owner = [w for w in found if w != "\n"], np.cumsum(ends)[~ends]
        else:
            lists = [self.pieces(c) for c in chunks]
            words = [w for ws in lists for w in ws]
            owner = np.repeat(np.arange(len(chunks)), [len(ws) for ws in lists])
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, counts = self.automaton.encode([w.encode() for w in known])
        which = np.array([known[w] for w in words], np.int64)
        flat, _ = gather(ids, np.cumsum(counts) - counts, counts, which)
        per_chunk = np.bincount(owner, counts[which], len(chunks)).astype(np.int64)
        at = len(self.chunks)
        self.starts = np.concatenate((self.starts, self.pool.size + np.cumsum(per_chunk) - per_chunk))
        self.counts = np.concatenate((self.counts, per_chunk))
        self.pool = np.concatenate((self.pool, flat))
        self.chunks.update(zip(chunks, range(at, at + len(chunks))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        lists = [self.parts(t) for t in texts]
        seen = set(chain.from_iterable(lists))
        new = seen.difference(self.chunks)
        if new and len(self.chunks) > _CACHE:
            self._clear()
            new = seen.difference(self.chunks)
        if new:
            self._learn(list(new))
        which = np.array(list(map(self.chunks.__getitem__, chain.from_iterable(lists))), np.int64)
        ids, ends = gather(self.pool, self.starts, self.counts, which)
        last = np.cumsum([0] + [len(part) for part in lists])
        ends = np.concatenate(([0], ends))
        return ids, np.diff(ends[last])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts that the ids spell (bytes of UTF-8): the labels of their arcs, joined by blanks."""
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64())
        labels = self.names.take(pa.array(ids))
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, labels), b" ")


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the pool that `which` names, one after another, and where each ends."""
    n = counts[which]
    ends = np.cumsum(n)
    return pool[np.repeat(starts[which] - (ends - n), n) + np.arange(n.sum())], ends


@cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: bool = True) -> DataFrame:
    """`keep` columns with n_tokens, ids (array of int, if wanted), ids_sha256 and decoded_sha256; no shuffle."""
    new = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")} | ({"ids": F.array(F.lit(0))} if ids else {})
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *without(keep, new))
    schema, names = rows.drop("__text").withColumns(new).schema, [*new]

    def encoded(batches):
        working("bpe", tokenizer)
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch):
                got, n = bpe.encode(part.column(0).to_pylist())
                decoded = [sha256(x).hexdigest() for x in bpe.decode(got, n).to_pylist()]
                data, ends = got.astype("<u4").tobytes(), np.cumsum(n)
                digests = [sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip((ends - n).tolist(), ends.tolist())]
                cols = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(got.view(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols], names=[*part.schema.names[1:], *names])

    return rows.mapInArrow(encoded, schema)


def slices(batch: pa.RecordBatch, size: int = 1_000_000):
    """Parts of a batch with about `size` bytes of its first column, a row at least."""
    lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size, "right")))
        yield batch.slice(at, n)
        at += n

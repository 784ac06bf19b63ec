"""Operator 11, repair of the structure of conversations by A* on the edit lattice.

A conversation's rows, in order of turn, are edited until the initials of their roles read (s?(ua)+)?: Keep costs 0, Rerole
to user or assistant 2, Delete 3 (required for blank rows and duplicates), Insert of an empty user or assistant turn 2, and a
truncated row that stays adds 1.  A node of the lattice is a number of rows done and a state of the automaton (start, after
s, after u, after a).  The heuristic is the suffix sum of what no path avoids, 3 for each required deletion and 1 for each
truncated row; the queue is keyed (cost plus heuristic, audit), so the first path to a node is the cheapest and, of the
cheapest, the one whose audit (initials of its edits) is least.  Two paths of one cost to one node are never prefixes of
each other, since what one would have beyond the other is insertions, which cost; so an order between them stays.

Spark deals the rows out by conversation once.  Within a task a window marks rows whose role and text came earlier, rows
are sorted by turn, and batches stream through the search: a conversation is searched in blocks of BLOCK rows, of which
each starts from the best path to each of the four states that the one before ended with.  What those paths have in
common is settled and leaves; each carries its own running SHA-256.  So a task holds one block and four paths, however
long a conversation is; only its audit, a letter an edit, grows with it, as the result asks.  A conversation is one chain
of SHA-256 and stays in one task for that reason.

Defined results: a null role or text is one space, a null turn sorts first and counts in no gap, a null conv_id is a
conversation like others; rows of one turn follow their roles, then their texts, and repeated rows lie next to each
other, the first of them being no duplicate; an empty role has no initial, so keeping it changes nothing; roles are known
by their first character; a conversation without rows after damage has zeros, an empty audit and the digest of the empty
text; the empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship
from .rules import SPACE

#: Rows that are searched at once.
BLOCK = 256
KEPT, TRUNCATED, BLANK, DUPLICATE, GONE = range(5)
#: What no path avoids, and what a row adds unless it is deleted.
_LEAST, _STAYS = (0, 1, 3, 3), (0, 1, None, None)
DELETE, REROLE, INSERT = 3, 2, 2
#: States: start, after s, after u, after a; the state after each initial that may follow.
START, ENDS = 0, (0, 3)
NEXT = ({"s": 1, "u": 2, "": 0}, {"u": 2, "": 1}, {"a": 3, "": 2}, {"u": 2, "": 3})
LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}


def search(rows: list[tuple[str, int]], entries: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str, int]]:
    """The best paths through a block of (initial, fault): state at its end -> cost, audit, state at its start.

    entries: cost and audit so far by state. If the block is the last, the one best path to an accepting state."""
    ahead = [0]
    for _, fault in reversed(rows):
        ahead.append(ahead[-1] + _LEAST[fault])
    ahead.reverse()
    queue = [(cost + ahead[0], audit, cost, 0, state, state) for state, (cost, audit) in entries.items()]
    queue.sort()
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str, int]] = {}
    while queue:
        _, audit, cost, at, state, came = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            found[state] = (cost, audit, came)
            if last and state in ENDS:
                return {state: found[state]}
        steps = [("I", INSERT, at, NEXT[state][r]) for r in "ua" if r in NEXT[state]]
        if at < len(rows):
            initial, fault = rows[at]
            steps.append(("D", DELETE, at + 1, state))
            if (stays := _STAYS[fault]) is not None:
                if initial in NEXT[state]:
                    steps.append(("K", stays, at + 1, NEXT[state][initial]))
                steps += [("R", REROLE + stays, at + 1, NEXT[state][r]) for r in "ua" if r in NEXT[state]]
        for letter, price, to, then in steps:
            if (to, then) not in done:
                heappush(queue, (cost + price + ahead[to], audit + letter, cost + price, to, then, came))
    return found


def replay(edits: str, state: int, rows: list[tuple]) -> list[tuple[str, str]]:
    """(role, text) of what edits leave of rows (initial, fault, role, text), from a state on."""
    out, at = [], 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        initial = rows[at][0] if e == "K" else next(r for r in "ua" if r in NEXT[state])
        state = NEXT[state][initial]
        out.append((rows[at][2] if e == "K" else ROLE[initial], "" if e == "I" else rows[at][3]))
        at += e != "I"
    return out


class _Conversation:
    """Counts and best paths of one conversation, fed row by row."""

    def __init__(self, conv, with_turns: bool, size: int):
        self.conv, self.size = conv, size
        self.turns: list | None = [] if with_turns else None
        self.low = self.high = None
        self.distinct, self.faults, self.illegal, self.before, self.any = 0, [0] * 4, 0, None, False
        self.settled: list[str] = []
        # state -> cost, audit since what is settled, digest, whether a line is in it, turns
        self.paths = {START: (0, "", sha256(), False, [] if with_turns else None)}
        self.rows: list[tuple[str, int, str, str]] = []

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if fault == GONE:
            return
        initial = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.any:
            self.illegal += self.before + initial not in LEGAL
        self.any, self.before = True, initial
        self.faults[fault] += 1
        if len(self.rows) == self.size:
            self._pass(False)
        self.rows.append((initial, fault, role, text))

    def _pass(self, last: bool) -> None:
        found = search([r[:2] for r in self.rows], {s: p[:2] for s, p in self.paths.items()}, last)
        after = {}
        for state, (cost, audit, came) in found.items():
            _, before, digest, began, turns = self.paths[came]
            digest, turns = digest.copy(), None if turns is None else list(turns)
            for role, text in replay(audit[len(before) :], came, self.rows):
                digest.update(("\n" if began else "").encode() + f"{role}:{text}".encode())
                began = True
                if turns is not None:
                    turns.append({"role": role, "text": text})
            after[state] = (cost, audit, digest, began, turns)
        common = commonprefix([p[1] for p in after.values()])
        self.settled.append(common)
        self.paths = {s: (c, a[len(common) :], *rest) for s, (c, a, *rest) in after.items()}
        self.rows = []

    def result(self) -> tuple:
        self._pass(True)
        ((cost, audit, digest, _, turns),) = self.paths.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        out = (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, "".join(self.settled) + audit, digest.hexdigest())
        return out if turns is None else (*out, turns)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and gone after a damage that crc32 of `conv:turn` chooses; rows that it drops stay as gone."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind"))
    hurt = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(times).alias("gone"))


def plain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and gone of conversations as they are."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(False).alias("gone"))


def _fault(earlier: Column) -> Column:
    ending = F.rtrim(F.col("text"), F.lit(SPACE))
    return (
        F.when(F.col("gone"), GONE)
        .when(ending == "", BLANK)
        .when(earlier, DUPLICATE)
        .when(~F.substring(ending, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(KEPT)
    )


def repair(rows: DataFrame, with_turns: bool = False, block: int = BLOCK) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, if wanted, repaired (the turns
    that the edits leave, as role and text; for conversations that fit into a row) of every conversation.

    rows: conv, turn, role, text, gone, as damaged() or plain() give them."""
    ship(rows.sparkSession)
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema += ", repaired array<struct<role:string,text:string>>" if with_turns else ""
    same = Window.partitionBy("conv", "gone", "role", F.md5(F.col("text").cast("binary")), "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv").withColumn("seen", F.row_number().over(same))
    ordered = dealt.select("conv", "turn", "role", "text", _fault(F.col("seen") > 1).alias("fault")).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "fault")

    def searched(batches):
        current, out, to = None, [], None
        for batch in batches:
            to = to or batch.schema.field(0).type
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv != current.conv:
                    if current is not None:
                        out.append(current.result())
                    current = _Conversation(conv, with_turns, block)
                current.add(turn, role, text, fault)
            if len(out) >= 1_000:
                yield _batch(out, to, with_turns)
                out = []
        if current is not None:
            yield _batch([*out, current.result()], to, with_turns)

    return ordered.mapInArrow(searched, schema)


def _batch(rows: list[tuple], conv: pa.DataType, with_turns: bool) -> pa.RecordBatch:
    types = [conv, *[pa.int64()] * 6, pa.string(), pa.string()] + ([pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))] if with_turns else [])
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: len(types)])


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS codes
  FROM conversations
), crc AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(flatten(list_transform(codes, lambda c: [c, 256, 256, 256, 256, 256, 256, 256, 256])),
    lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT)) % 20 AS k
  FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM crc, (SELECT unnest([1, 2]) AS copy) WHERE k <> 0 AND (copy = 1 OR k = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), faulted AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c0,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN seen > 1 THEN 3
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 2) AS blank,
    count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulted GROUP BY conv_id
), nxt(q, c, q1) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)
), inserts(q, q1, lines) AS (
  VALUES (0, 0, []::VARCHAR[]), (1, 1, []), (2, 2, []), (3, 3, []), (0, 2, ['user:']), (1, 2, ['user:']), (3, 2, ['user:']),
    (2, 3, ['assistant:']), (0, 3, ['user:', 'assistant:']), (1, 3, ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, i, q, q1, 'K' AS e, (fault = 1)::INT AS cost, [role || ':' || text] AS lines FROM faulted JOIN nxt USING (c) WHERE fault < 2
  UNION ALL SELECT conv_id, i, q, q1, 'R', 2 + (fault = 1)::INT, [CASE nxt.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM faulted, nxt WHERE fault < 2 AND nxt.c IN ('u', 'a')
  UNION ALL SELECT conv_id, i, q, q, 'D', 3, [] FROM faulted, (SELECT unnest(range(4))::INT AS q)
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, e.i, e.q1, min({'cost': p.best.cost + 2 * len(s.lines)::INT + e.cost, 'audit': p.best.audit || repeat('I', len(s.lines)) || e.e,
    'lines': p.best.lines || s.lines || e.lines})
  FROM paths p JOIN inserts s ON s.q = p.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.q = s.q1
  GROUP BY p.conv_id, e.i, e.q1
), ended AS (
  SELECT p.conv_id, min({'cost': p.best.cost + 2 * len(s.lines)::INT, 'audit': p.best.audit || repeat('I', len(s.lines)), 'lines': p.best.lines || s.lines}) AS best
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN inserts s ON s.q = p.q AND s.q1 IN (0, 3)
  GROUP BY p.conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
"""

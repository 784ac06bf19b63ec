"""The change of a SELECT as SQL: a signed list of queries over old, new, added and removed rows of what it reads.

The tables of a query change one after the other, those before one are new already, those after it still old.  A query is
linear in a table whose rows each make rows of their own (FROM, inner joins, the kept side of an outer join): its change is
the query over the added rows less that over the removed ones.  The one row of a scalar subquery (a table by the name of
ONE, which only WHERE reads) changes the rows that its new value lets through and its old one did not, or the other way
round: one pass over the rest, without a shuffle.  A table that only decides about rows of others (the other
side of an outer join, a semi or anti join, EXISTS, IN) changes the rows that match one of its changed rows, and no others:
the query is run for those alone, once with the new table and once with the old.  A full outer join also has the changed
rows that match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..model import Name
from ..plans.shape import clause_texts, listed, tokens

_JOIN = {"inner", "left", "right", "full", "cross", "outer", "semi", "anti", "natural", "join"}
_RELATION = re.compile(r"(?:(\w+)\s*\.\s*)?(\w+)(?:\s+(?:as\s+)?(\w+))?", re.I)
_KINDS = (("natural", None), ("semi", "LEFT SEMI"), ("anti", "LEFT ANTI"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("cross", "CROSS"))
_DECIDES = ("LEFT", "LEFT SEMI", "LEFT ANTI")
_AGGREGATE = r"(?i)\b(count|sum|min|max|avg|mean)\s*\("
#: Names of hidden nodes: a scalar subquery's one row, and its column; a side of a set operation.
ONE, VALUE, SIDE = "mr_one", "mr_value", "mr_side"


@dataclass
class Part:
    """A table of a FROM clause, how it is joined to those before it, and on what."""

    join: str
    name: Name
    alias: str
    on: str = ""

    def condition(self, first: str) -> str:
        """The condition, as one in terms of both aliases."""
        if self.on.lower().startswith("using"):
            return " AND ".join(f"{self.alias}.{c} = {first}.{c}" for c in listed(self.on[self.on.index("(") + 1 : self.on.rindex(")")]))
        return self.on[2:].strip() or "true"


@dataclass
class Sub:
    """A subquery of EXISTS or IN: what comes before IN, and its own clauses."""

    column: str | None
    select: str
    parts: list[Part]
    where: str

    def text(self, names: list[str]) -> str:
        return f"(SELECT {self.select} FROM {from_text(self.parts, names)}" + (f" WHERE {self.where}" if self.where else "") + ")"


@dataclass
class Block:
    """One SELECT, in pieces that can be put together again over other tables."""

    select: str
    parts: list[Part]
    where: list[str | Sub] = field(default_factory=list)
    group: str = ""
    having: str = ""

    @property
    def subs(self) -> list[Sub]:
        return [w for w in self.where if isinstance(w, Sub)]

    @property
    def tables(self) -> list[Name]:
        return [p.name for p in self.parts] + [p.name for s in self.subs for p in s.parts]

    @property
    def negated(self) -> bool:
        return any(t.lower() == "not" for w in self.where if isinstance(w, str) for t in tokens(w))

    def sql(self, names: list[str], extra: str = "", select: str | None = None, group: str | None = None, having: str | None = None, joins: list[str] | None = None, also: str = "", was: tuple[str, str] | None = None) -> str:
        """was: an alias and another table for it, with which the rows do not pass WHERE."""
        at = iter(names[len(self.parts) :])
        where = "".join(w if isinstance(w, str) else w.text([next(at) for _ in w.parts]) for w in self.where)
        before = f"NOT coalesce(({re.sub(rf'\b{was[0]}\.', 'mr_was.', where)}), false)" if was else ""
        conditions = " AND ".join(f"({c})" for c in (where, extra, also, before) if c)
        group, having = self.group if group is None else group, self.having if having is None else having
        return (
            f"SELECT {self.select if select is None else select} FROM {from_text(self.parts, names, joins)}"
            + (f" CROSS JOIN {was[1]} AS mr_was" if was else "")
            + (f" WHERE {conditions}" if conditions else "")
            + (f" GROUP BY {group}" if group else "")
            + (f" HAVING {having}" if having else "")
        )

    def linear(self, i: int) -> bool:
        if i >= len(self.parts):
            return False
        own, later = self.parts[i].join, [p.join for p in self.parts[i + 1 :]]
        return own not in (*_DECIDES, "FULL") and not {"RIGHT", "FULL"} & set(later)

    def touched(self, i: int, names: list[str]) -> str:
        """Condition on the rows that changed rows of table i decide about; names has the changed rows in its place."""
        if i >= len(self.parts):
            at = len(self.parts)
            for s in self.subs:
                if i < at + len(s.parts):
                    inner = s.text(names[at : at + len(s.parts)])
                    if s.column is None:
                        return f"EXISTS {inner}"
                    return f"{s.column} IN {inner}" + (f" OR {s.column} IS NULL" if self.negated else "")
                at += len(s.parts)
        p = self.parts[i]
        condition = (p if i else self.parts[1]).condition(self.parts[0].alias)
        return f"EXISTS (SELECT 1 FROM {names[i]} AS {p.alias} WHERE {condition})"

    def signed(self, changed: set[str], view: Callable[[Name, str], str | None], **how) -> Iterator[tuple[int, str]]:
        """(sign, SQL) of the change. view(name, role) names the rows of a table that are new, old, plus, minus, both (of
        these) or none; None if there are none. how: as for sql()."""
        for i, name in enumerate(self.tables):
            if str(name) not in changed:
                continue
            base = [view(n, "new" if j < i else "old") for j, n in enumerate(self.tables)]
            put = lambda role, at=i, name=name, base=base: [*base[:at], view(name, role), *base[at + 1 :]]
            signs = [(s, r) for s, r in ((1, "plus"), (-1, "minus")) if view(name, r)]
            if i < len(self.parts) and self.parts[i].alias.startswith(ONE):
                for s, now, was in ((1, "new", "old"), (-1, "old", "new")):
                    yield s, self.sql(put(now), was=(self.parts[i].alias, view(name, was)), **how)
                continue
            if self.linear(i):
                yield from ((s, self.sql(put(r), **how)) for s, r in signs)
                continue
            condition = self.touched(i, put("both"))
            full = len(self.parts) == 2 and i < 2 and self.parts[1].join == "FULL"
            joins = ["", ("RIGHT", "LEFT")[i]] if full else None
            yield from ((s, self.sql(put(r), condition, joins=joins, **how)) for s, r in ((1, "new"), (-1, "old")))
            if full:  # changed rows that match nothing
                other = self.parts[1 - i]
                alone = f"NOT EXISTS (SELECT 1 FROM {base[1 - i]} AS {other.alias} WHERE {self.parts[1].condition(self.parts[0].alias)})"
                for s, r in signs:
                    names = put(r)
                    names[1 - i] = view(other.name, "none")
                    yield s, self.sql(names, alone, joins=["", ("LEFT", "RIGHT")[i]], **how)


def from_text(parts: list[Part], names: list[str], joins: list[str] | None = None) -> str:
    out = []
    for k, (p, n) in enumerate(zip(parts, names)):
        join = joins[k] if joins else p.join
        out.append(f"{join} JOIN {n} AS {p.alias} {p.on}" if k else f"{n} AS {p.alias}")
    return " ".join(out)


def parts_of(text: str) -> list[Part] | None:
    """The tables of a FROM clause; None if it has anything but names, joins and commas."""
    chunks: list[tuple[list[str], list[str]]] = [([], [])]
    toks, depth, i = tokens(text), 0, 0
    after = lambda k: next((t for t in toks[k + 1 :] if not t.isspace()), "")
    while i < len(toks):
        t = toks[i]
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() in _JOIN and after(i) != "(":
            words = []
            while toks[i].isspace() or toks[i].lower() in _JOIN:
                words += [] if toks[i].isspace() else [toks[i].lower()]
                i += 1
            chunks.append((words, []))
            continue
        if depth == 0 and t == ",":
            chunks.append((["cross"], []))
        else:
            chunks[-1][1].append(t)
        i += 1
    out = []
    for words, toks in chunks:
        at = next((k for k, t in enumerate(toks) if t.lower() in ("on", "using")), len(toks))
        m = _RELATION.fullmatch("".join(toks[:at]).replace("`", "").strip())
        kind = next((k for w, k in _KINDS if w in words), "INNER")
        if not m or kind is None:
            return None
        out.append(Part(kind if words else "", Name(m[1], m[2]) if m[1] else Name.parse(m[2]), m[3] or m[2], "".join(toks[at:]).strip()))
    outer = [p for p in out[1:] if p.join in (*_DECIDES, "RIGHT", "FULL")]
    if any(p.join in ("RIGHT", "FULL") for p in outer) and (len(out) > 2 or not out[1].on.lower().startswith("on")):
        return None
    if any(p.on.lower().startswith("using") for p in outer) and len(out) > 2:
        return None
    return out


def where_of(text: str) -> list[str | Sub] | None:
    """A condition, cut at the subqueries of EXISTS and IN; None if there are others."""
    toks, out, now, i = tokens(text), [], [], 0
    while i < len(toks):
        first = next((t for t in toks[i + 1 :] if not t.isspace()), "")
        if toks[i] != "(" or first.lower() not in ("select", "with"):
            now.append(toks[i])
            i += 1
            continue
        depth, end = 0, i
        while True:
            depth += (toks[end] == "(") - (toks[end] == ")")
            if not depth:
                break
            end += 1
        before = [t for t in now if not t.isspace()]
        word = before[-1].lower() if before else ""
        column = before[-3 if len(before) > 1 and before[-2].lower() == "not" else -2] if word == "in" and len(before) > 1 else None
        c = clause_texts("".join(toks[i + 1 : end]))
        parts = parts_of(c.get("from", ""))
        plain = set(c) <= {"select", "from", "where"} and parts and all(p.join in ("", "INNER", "CROSS") for p in parts)
        inside = "".join(toks[i + 1 : end])
        if word not in ("exists", "in") or word == "in" and not re.fullmatch(r"[\w.]+", column or "") or not plain:
            return None
        if re.search(r"(?i)\(\s*(select|with)\b|\b(union|intersect|except|over|distinct)\b", inside) or re.search(_AGGREGATE, inside):
            return None
        out += ["".join(now), Sub(column, c["select"], parts, c.get("where", ""))]
        now, i = [], end + 1
    return [*out, "".join(now)] if "".join(now).strip() or out else []


def block_of(query: str) -> Block | None:
    """The pieces of a plain SELECT; None if it is anything else."""
    c = clause_texts(query)
    if not {"select", "from"} <= set(c) or set(c) - {"select", "from", "where", "group by", "having"}:
        return None
    parts, where = parts_of(c["from"]), where_of(c.get("where", ""))
    if parts is None or where is None or any(re.search(r"(?i)\(\s*(select|with)\b", c.get(k, "")) for k in ("select", "group by", "having", "from")):
        return None
    return Block(c["select"], parts, where, c.get("group by", ""), c.get("having", ""))


def set_sides(query: str) -> tuple[list[str], list[str]] | None:
    """(operations, sides) of set operations outside brackets; None if there are none or something follows them all."""
    toks, depth, ops, sides = tokens(query.strip().rstrip(";")), 0, [], [[]]
    for t in toks:
        low = t.lower()
        depth += (t == "(") - (t == ")")
        if depth == 0 and low in ("union", "intersect", "except", "minus"):
            ops.append(low.replace("minus", "except"))
            sides.append([])
        elif depth == 0 and low in ("all", "distinct") and ops and not "".join(sides[-1]).strip():
            ops[-1] += " all" if low == "all" else ""
        elif depth == 0 and low in ("order", "limit", "offset", "sort", "cluster", "distribute") and ops:
            return None
        else:
            sides[-1].append(t)
    return (ops, [_unwrapped("".join(s)) for s in sides]) if ops else None


def _unwrapped(text: str) -> str:
    """A query without brackets around all of it."""
    text = text.strip()
    while text.startswith("("):
        depth = 0
        for k, t in enumerate(toks := tokens(text)):
            depth += (t == "(") - (t == ")")
            if not depth:
                break
        if k < len(toks) - 1:
            return text
        text = "".join(toks[1:-1]).strip()
    return text


def set_operation(query: str) -> tuple[str, str, str] | None:
    """(operation, left, right) of two queries; None if there are more or fewer."""
    cut = set_sides(query)
    return (cut[0][0], *cut[1]) if cut and len(cut[0]) == 1 else None


def _plain(text: str) -> bool:
    """Whether a query is one SELECT whose rows each come from one row of each table."""
    b = None if set_sides(text) else block_of(text)
    return b is not None and not (b.group or b.having or re.search(r"(?i)\bover\b|^\s*distinct\b", b.select) or re.search(_AGGREGATE, b.select))


def _folded(ops: list[str], sides: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """One set operation (or UNION ALL of any number) of plain sides by names, and the other sides as (name, query).

    INTERSECT binds first, the rest from left to right."""
    found: list[tuple[str, str]] = []

    def taken(text: str) -> str:
        if _plain(text):
            return text
        found.append((f"{SIDE}{len(found)}", text))
        return f"SELECT * FROM {found[-1][0]}"

    join = lambda a, op, b: f"({a}) {op.upper()} ({b})"
    left, rest = sides[0], []
    terms = [left]
    for op, side in zip(ops, sides[1:]):
        if op.startswith("intersect") and set(ops) - {"intersect", "intersect all"}:
            terms[-1] = join(terms[-1], op, side)
        else:
            rest.append(op)
            terms.append(side)
    if set(rest) == {"union all"}:
        return " UNION ALL ".join(taken(t) for t in terms), found
    left = terms[0]
    for op, side in zip(rest[:-1], terms[1:-1]):
        left = join(left, op, side)
    return f"{taken(left)} {rest[-1].upper()} {taken(terms[-1])}", found


_RECURSION = re.compile(r"(?is)\s*with\s+recursive\s+([a-z_]\w*)\s*(\([\w\s,]*\))?\s*as\s*\(")


def _recursion_of(query: str) -> tuple[str, list[tuple[str, str]]] | None:
    """The query over one recursive WITH entry, and that entry alone; None if it is that alone, or has others."""
    m = _RECURSION.match(query)
    if not m:
        return None
    depth, end, rest = 1, 0, tokens(query[m.end() :])
    for end, t in enumerate(rest):
        depth += (t == "(") - (t == ")")
        if not depth:
            break
    outer = "".join(rest[end + 1 :]).strip().rstrip(";").strip()
    name = m[1].lower()
    if not outer.lower().startswith("select") or re.fullmatch(rf"(?is)select\s+\*\s+from\s+{name}", outer):
        return None
    return outer, [(name, f"{query[: m.end()].strip()}{''.join(rest[:end])}) SELECT * FROM {name}")]


def recursion(query: str) -> tuple[Name, list[str], Block, Block] | None:
    """(own name, column names, start, step) of WITH RECURSIVE r AS (start UNION step) SELECT * FROM r, where step reads r once."""
    m = _RECURSION.match(query)
    body = re.fullmatch(rf"(?is)(.*)\)\s*select\s+\*\s+from\s+{re.escape(m[1])}\s*;?\s*", query[m.end() :]) if m else None
    cut = set_operation(body[1]) if body else None
    if not cut or cut[0] != "union":
        return None
    start, step = block_of(cut[1]), block_of(cut[2])
    own = Name.parse(m[1])
    if start is None or step is None or own in start.tables or step.tables.count(own) != 1 or any(b.group or b.having for b in (start, step)):
        return None
    if not all(b.linear(i) for b in (start, step) for i in range(len(b.tables))):
        return None
    return own, listed(m[2][1:-1]) if m[2] else [], start, step


def _scalars(query: str) -> tuple[str, list[tuple[str, str]]]:
    """The query with the one row of each scalar subquery of WHERE joined by name, and these subqueries (name, query).

    Only aggregates without GROUP BY, which have one row whatever they read; whether they read outer columns is seen when
    they are run alone."""
    c = clause_texts(query)
    if not {"select", "from", "where"} <= set(c) or any(i.endswith("*") for i in listed(c["select"])) or set_sides(query):
        return query, []
    toks, out, found, i = tokens(c["where"]), [], [], 0
    while i < len(toks):
        first = next((t.lower() for t in toks[i + 1 :] if not t.isspace()), "")
        if toks[i] != "(" or first != "select":
            out.append(toks[i])
            i += 1
            continue
        depth, end = 0, i
        while True:
            depth += (toks[end] == "(") - (toks[end] == ")")
            if not depth:
                break
            end += 1
        inside = "".join(toks[i + 1 : end])
        word = next((t.lower() for t in reversed(out) if not t.isspace()), "")
        own = clause_texts(inside)
        items = listed(own.get("select", ""))
        one = len(items) == 1 and re.match(r"(?is)(count|sum|min|max|avg|mean)\s*\(", items[0]) and set(own) <= {"select", "from", "where"} and "from" in own
        if word in ("in", "exists", "any", "some", "all") or not one or set_sides(inside) or re.search(r"(?i)\bover\b|\)\s*(as\s+)?\w+$", items[0]):
            out.append("".join(toks[i : end + 1]))
        else:
            name = f"{ONE}{len(found)}"
            found.append((name, f"SELECT {items[0]} AS {VALUE} FROM {own['from']}" + (f" WHERE {own['where']}" if "where" in own else "")))
            out.append(f"{name}.{VALUE}")
        i = end + 1
    if not found or parts_of(f"{c['from']} CROSS JOIN {ONE}") is None:
        return query, []
    c["from"] += "".join(f" CROSS JOIN {n}" for n, _ in found)
    c["where"] = "".join(out)
    return " ".join(f"{k.upper()} {v}" for k, v in c.items()), found


def blocks_of(query: str) -> tuple[str, list[tuple[str, str]]] | None:
    """The query over its derived tables, WITH entries, scalar subqueries and sides of set operations by name, and these
    (name, query); None if they cannot be taken out."""
    found: list[tuple[str, str]] = []
    toks, i = tokens(query.strip().rstrip(";")), 0
    skip = lambda k: next((j for j in range(k, len(toks)) if not toks[j].isspace()), len(toks))

    def close(k: int) -> int:
        depth = 0
        for j in range(k, len(toks)):
            depth += (toks[j] == "(") - (toks[j] == ")")
            if not depth:
                return j
        return len(toks)

    i = skip(0)
    if i < len(toks) and toks[i].lower() == "with":
        i = skip(i + 1)
        while True:
            name, at = toks[i], skip(i + 1)
            if name.lower() == "recursive":
                return _recursion_of(query)
            if at >= len(toks) or toks[at].lower() != "as":
                return None
            begin = skip(at + 1)
            end = close(begin)
            found.append((name.lower(), "".join(toks[begin + 1 : end]).strip()))
            i = skip(end + 1)
            if i < len(toks) and toks[i] == ",":
                i = skip(i + 1)
                continue
            break
        toks, i = toks[i:], 0
    cut = set_sides("".join(toks))
    if cut:
        outer, sides = _folded(*cut)
        return (outer, found + sides) if sides else ("".join(toks).strip(), found)
    out, in_from, depth = [], False, 0
    while i < len(toks):
        t = toks[i]
        if depth == 0 and t.lower() in ("select", "from", "where", "group", "having", "order", "limit"):
            in_from = t.lower() == "from"
        first = toks[skip(i + 1)].lower() if skip(i + 1) < len(toks) else ""
        if t == "(" and depth == 0 and in_from and first in ("select", "with"):
            end = close(i)
            at = skip(end + 1)
            at = skip(at + 1) if at < len(toks) and toks[at].lower() == "as" else at
            if at >= len(toks) or not re.fullmatch(r"[A-Za-z_]\w*", toks[at]) or toks[at].lower() in (*_JOIN, "on", "where", "group", "order", "limit"):
                return None
            found.append((toks[at].lower(), "".join(toks[i + 1 : end]).strip()))
            out.append(toks[at])
            i = at + 1
            continue
        depth += (t == "(") - (t == ")")
        out.append(t)
        i += 1
    outer, ones = _scalars("".join(out).strip())
    found += ones
    return (outer, found) if len({n for n, _ in found}) == len(found) else None

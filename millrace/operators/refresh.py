"""Filling nodes: whole, or from the changes of their inputs.

A refresh notes the versions of what it reads and reads those, whatever is added meanwhile.  It ends with one commit of one
record that has the result, the hidden state and the noted versions; a refresh that fails before leaves nothing behind, and
one that finds the node moved on by another starts over.  So each change counts once.

How a query follows its inputs (Rule.kind):

bag      selects, filters, joins of all kinds, EXISTS and IN: signed rows by deltas.py, also of both sides of UNION ALL
sums     grouped or DISTINCT: counts and sums beside each group, in buckets by the hash of the group's keys; MIN and MAX
         (once rows were removed) and COUNT(DISTINCT) by the counts of each group's values; ROLLUP, CUBE and GROUPING SETS
         with the grouping as one more key
sets     UNION, INTERSECT, EXCEPT (ALL): how often each row is on each side
groups   HAVING, expressions over aggregates, floating sums after deletes: groups that the change touches, again
windows  partitions that the change touches, again
top      ORDER BY and LIMIT: the first rows and a reserve, refilled when deletes exhaust it
closure  WITH RECURSIVE .. UNION ..: round by round, only the rows of the last round are joined again; added rows start from
         what they add, removed ones take back what may rest on them, and what has another ground comes again (if that
         is much of it, all of it is closed anew); a refresh that failed goes on after the last round that it wrote
full     anything else

Derived tables, WITH entries, scalar subqueries that are aggregates, and sides of set operations that are more than plain
SELECTs are hidden nodes of their own, whose changes feed the query around them.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StructType

from ..model import Mode, Name, Node
from ..plans.shape import Shape, clause_texts, listed, references, relocate, shape, tokens
from ..sources.tables import Conflict, Tables, bucket_of
from .deltas import Block, block_of, blocks_of, recursion, set_sides

_ALIAS = re.compile(r"^(.*?)(?:\s+AS\s+(\w+|`[^`]+`)|(?<=[\w)'`])\s+(?!(?:end|null|true|false)$)(\w+))?$", re.I | re.S)
_CALL = re.compile(r"^\s*(sum|count|avg|mean|min|max)\s*\((.*)\)\s*$", re.I | re.S)
_SETS = re.compile(r"(?is)^\s*(rollup|cube|grouping\s+sets)\s*\((.*)\)\s*$")
#: Rows of ORDER BY .. LIMIT k that are held, in terms of k: k, as many again and some.
RESERVE = 100
#: How often a refresh starts over when others refresh the same node.
TRIES = 5


@dataclass
class Rule:
    """How a query is maintained."""

    kind: str
    blocks: list[Block] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)  # texts of the grouping (or partitioning) expressions
    key_at: list[int] = field(default_factory=list)  # their places in the SELECT list
    calls: dict[int, tuple[str, str]] = field(default_factory=dict)  # place -> function, argument
    grouping: str = ""  # GROUP BY of the state, if it is not just the keys
    op: str = ""  # set operation
    order: str = ""
    limit: int = 0

    @property
    def block(self) -> Block:
        return self.blocks[0]

    @property
    def extremes(self) -> list[int]:
        return [i for i, (f, _) in self.calls.items() if f in ("min", "max")]

    @property
    def distinct(self) -> list[int]:
        return [i for i, (f, _) in self.calls.items() if f == "distinct"]

    @property
    def tables(self) -> list[Name]:
        return [n for b in self.blocks for n in b.tables if str(n) != self.op]


_FULL = Rule("full")
_same = lambda x: re.sub(r"\s+", " ", x.lower().strip())
_bare = lambda x: re.sub(r"\s+", "", x.lower()).rsplit(".", 1)[-1] if re.fullmatch(r"\s*[\w.`]+\s*", x) else _same(x)


def rule_for(spark: SparkSession, query: str) -> Rule:
    s: Shape = shape(spark, query)
    if s.command or s.volatile or not s.relations:
        return _FULL
    if "with" in s.clauses:
        found = recursion(query)
        return Rule("closure", list(found[2:]), found[1], op=str(found[0])) if found else _FULL
    if s.set_op:
        return _set_rule(spark, query)
    if s.clauses.get("globallimit") or s.clauses.get("sort"):
        return _top_rule(spark, query, s)
    b = block_of(query)
    if b is None or "offset" in s.clauses:
        return _FULL
    over = re.search(r"(?i)\bover\b", b.select)
    if s.distinct:
        b.select = re.sub(r"(?i)^\s*distinct\b", "", b.select)
    items = [_ALIAS.match(i.strip()).groups() for i in listed(b.select)]
    texts, names = [i[0].strip() for i in items], [(i[1] or i[2] or "").strip("`").lower() for i in items]
    grouped = s.grouped and not (over and not b.group)  # a window's function alone groups nothing
    if not grouped:
        if over:
            return _FULL if s.distinct else _window_rule(b)
        if not s.distinct:
            return Rule("bag", [b])
        if any(t.endswith("*") for t in texts):
            return _FULL
        return Rule("sums", [b], texts, list(range(len(texts))))
    if over or s.distinct:
        return _FULL
    grouping = b.group if _SETS.match(b.group) else ""
    if grouping:
        keys = list(dict.fromkeys(re.findall(r"[\w.]+", _SETS.match(b.group)[2])))
    else:
        keys = []
        for g in listed(b.group):
            at = int(g) - 1 if g.isdigit() else names.index(g.lower()) if g.lower() in names and _same(g) not in map(_same, texts) else -1
            keys.append(texts[at] if at >= 0 else g)
    if any(re.match(r"(?i)(rollup|cube|grouping)\b", k) for k in keys) or re.search(r"(?i)\bwith\s+(rollup|cube)\b", b.group):
        return _FULL
    b.group = grouping or ", ".join(keys)
    places = [next((i for i, t in enumerate(texts) if _same(t) == _same(k) or _bare(t) == _bare(k)), -1) for k in keys]
    calls = {}
    for i, t in enumerate(texts):
        m = _CALL.match(t)
        if m and m[2].count("(") == m[2].count(")") and _one_call(t):
            apart = re.match(r"(?is)\s*distinct\b(.*)", m[2])
            if not apart:
                calls[i] = (m[1].lower().replace("mean", "avg"), m[2].strip())
            elif m[1].lower() == "count" and len(listed(apart[1])) == 1 and not grouping:
                calls[i] = ("distinct", apart[1].strip())
    if not b.having and all(i in calls or i in places for i in range(len(texts))) and -1 not in places:
        return Rule("sums", [b], [*keys, "grouping_id()"] if grouping else keys, places, calls, grouping)
    return Rule("groups", [b], keys) if keys and not grouping else _FULL


def _set_rule(spark: SparkSession, query: str) -> Rule:
    ops, texts = set_sides(query) or ([], [])
    if len(ops) != 1 and set(ops) != {"union all"}:
        return _FULL
    sides = [rule_for(spark, q) for q in texts]
    if any(r.kind != "bag" or len(r.blocks) != 1 for r in sides):
        return _FULL
    return Rule("bag" if ops[0] == "union all" else "sets", [r.block for r in sides], op=ops[0])


def _window_rule(b: Block) -> Rule:
    """All windows must have the same PARTITION BY, of columns that do not come from a table which may be null-extended."""
    found = re.findall(r"(?is)\bover\s*\((.*?)(?:\border\s+by\b|\brows\b|\brange\b|\))", b.select)
    if len(found) != len(re.findall(r"(?i)\bover\b", b.select)):
        return _FULL
    keys = {_same(re.sub(r"(?i)^\s*partition\s+by\b", "", f)) if re.match(r"(?i)\s*partition\s+by\b", f) else "" for f in found}
    if len(keys) != 1 or "" in keys or "(" in (only := keys.pop()):
        return _FULL
    return Rule("windows", [b], [k.strip() for k in only.split(",")])


def _top_rule(spark: SparkSession, query: str, s: Shape) -> Rule:
    c = clause_texts(query)
    if not {"order by", "limit"} <= set(c) or not c["limit"].isdigit() or s.grouped or s.distinct or "offset" in s.clauses:
        return _FULL
    b = block_of(" ".join(f"{k.upper()} {v}" for k, v in c.items() if k not in ("order by", "limit")))
    if b is None or re.search(r"(?i)\bover\b|\(\s*(select|with)\b", b.select + c["order by"]):
        return _FULL
    return Rule("top", [b], order=c["order by"], limit=int(c["limit"]))


def _one_call(text: str) -> bool:
    """The first bracket closes at the very end."""
    depth = 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == ")" and depth == 0:
            return i == len(text.rstrip()) - 1
    return False


#: Rows up to which Spark may decide by the size of files, which are small for rows that repeat much, whether to broadcast.
BROADCAST_ROWS = 1_000_000
#: A recursion with more than one in so many of its rows in doubt is closed anew.
DOUBTFUL = 20


class _Views:
    """Temporary views of table versions and changes, for as long as it takes to analyse a query."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {}

    def of(self, key: tuple, df) -> str:
        if key not in self.names:
            name = f"mr_{uuid.uuid4().hex}"
            df().createOrReplaceTempView(name)
            self.names[key] = name
        return self.names[key]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.names.values():
            self.spark.catalog.dropTempView(name)


@dataclass
class _Run:
    """A refresh of one node: versions before and now, and the changes between them."""

    node: Node
    rule: Rule
    now: dict[str, int]
    old: dict[str, int] = field(default_factory=dict)
    changes: dict[str, tuple[DataFrame | None, DataFrame | None]] = field(default_factory=dict)

    @property
    def removes(self) -> bool:
        """Whether rows of the query may go: rows of a table went, or one changed that decides about the rows of others."""
        decides = (not b.linear(i) for b in self.rule.blocks for i, n in enumerate(b.tables) if str(n) in self.changes)
        return any(c[1] is not None for c in self.changes.values()) or any(decides)


class Refresher:
    def __init__(self, spark: SparkSession, tables: Tables):
        self.spark, self.tables = spark, tables
        self._rounds: dict[tuple, list[str]] = {}  # folders of closures that have not ended

    # queries over versions

    def frame(self, query: str, versions: dict[str, int] | None = None, closed: bool = True) -> DataFrame:
        """The query over current (or given) versions of what it reads; other names are left to the session.

        A recursion of UNION, which Spark's SQL does not have, is closed first; where only columns or estimates are wanted
        (closed=False), its first rows stand for it."""
        recursive = re.match(r"(?i)\s*with\s+recursive\b", query)
        cut = blocks_of(query) if recursive else None
        if recursive and rule_for(self.spark, cut[1][0][1] if cut else query).kind == "closure":
            name, text = cut[1][0] if cut else ("", query)
            run = _Run(Node(Name("public", "mr_closure"), text), rule_for(self.spark, text), versions or self.inputs(query))
            whole = self.tables.frame(self._fill_closure(run, text)) if closed else self._start(run)
            if not cut:
                return whole
            with _Views(self.spark) as views:
                own = views.of((name,), lambda: whole)
                rename = lambda n, _: f"{own}" if n == Name.parse(name) else self._view(views, n, (versions or {}).get(str(n)))
                return self.spark.sql(relocate(cut[0], rename))
        with _Views(self.spark) as views:
            return self.spark.sql(self._placed(query, lambda n: self._view(views, n, (versions or {}).get(str(n)))))

    def _placed(self, query: str, rename) -> str:
        known = set(references(self.spark, query))
        return relocate(query, lambda n, _: rename(n) if n in known else None)

    def _view(self, views: _Views, name: Name, version: int | None = None) -> str | None:
        v = version or self.tables.version(name)
        return views.of((str(name), v), lambda: self.tables.read(name, v)) if v else None

    def _uses(self, query: str) -> list[tuple[Name, int]]:
        return [(n, 0) for n in references(self.spark, query)]

    def inputs(self, query: str) -> dict[str, int]:
        return {str(n): v for n in references(self.spark, query) if (v := self.tables.version(n))}

    def _over(self, run: _Run, block: Block, extra: str = "", more: dict[str, DataFrame] | None = None, **how) -> DataFrame:
        """A block over the noted versions; `more` are frames that `extra` reads by name."""
        with _Views(self.spark) as views:
            for n, df in (more or {}).items():
                extra = extra.replace(n, views.of((n,), lambda df=df: df))
            return self.spark.sql(block.sql([self._view(views, n, run.now[str(n)]) for n in block.tables], extra, **how))

    def _signed(self, run: _Run, block: Block, **how) -> list[tuple[int, DataFrame]]:
        """(sign, rows) whose signed union is the change of a block."""
        with _Views(self.spark) as views:

            def view(name: Name, role: str) -> str | None:
                key = str(name)
                if role in ("new", "old"):
                    return self._view(views, name, (run.now if role == "new" else run.old)[key])
                if role == "none":
                    return views.of((key, role), lambda: self.tables.read(name, run.now[key]).limit(0))
                both = run.changes[key]
                if role == "both":
                    return views.of((key, role), lambda: _union([c for c in both if c is not None]))
                df = both[role == "minus"]
                return None if df is None else views.of((key, role), lambda: df)

            return [(sign, self.spark.sql(text)) for sign, text in block.signed(set(run.changes), view, **how)]

    # whole

    def full(self, node: Node) -> str:
        for _ in range(TRIES):
            try:
                return self._full(node, *self._outer(node))
            except Conflict:
                continue
        raise Conflict(f"{node.name} is refreshed by others all the time")

    def _full(self, node: Node, query: str, hidden: dict[str, str]) -> str:
        since = self.tables.version(node.name)
        now = self.inputs(query)
        rule = rule_for(self.spark, query) if node.mode != Mode.FULL else _FULL
        if {str(n) for n in rule.tables} - set(now):
            rule = _FULL  # it reads something without versions
        run = _Run(node, rule, now)
        entry = getattr(self, f"_fill_{rule.kind}", self._fill_plain)(run, query)
        self._commit(run, since, entry | {"full": True}, hidden)
        return "full"

    def _commit(self, run: _Run, since: int, entry: dict, hidden: dict[str, str]) -> None:
        self.tables.commit(run.node.name, since, entry | {"inputs": {"versions": run.now, "query": run.node.query, "hidden": hidden}})

    def seen(self, name: Name | str) -> dict | None:
        """Input versions and query of what a node holds."""
        return (self.tables.entry(name) or {}).get("inputs")

    def _outer(self, node: Node) -> tuple[str, dict[str, str]]:
        """The query over hidden nodes for its derived tables and WITH entries, brought up to date, and their names."""
        cut = blocks_of(node.query) if node.mode != Mode.FULL else None
        if not cut or not cut[1] or shape(self.spark, node.query).volatile:
            return node.query, {}
        outer, blocks = cut
        names = {Name.parse(alias): Name(node.name.schema, f"{node.name.name}__{alias}") for alias, _ in blocks}
        place = lambda q: relocate(q, lambda n, _: str(names[n]) if n in names else None)
        new = {alias for alias, _ in blocks if self.tables.entry(names[Name.parse(alias)]) is None}
        if any(alias in new and not set(references(self.spark, text)) & set(names) and not self._alone(text) for alias, text in blocks):
            return node.query, {}
        made: list[str] = []
        for alias, text in blocks:
            hidden = names[Name.parse(alias)]
            if alias in new and not self._alone(place(text)):
                for h in made:
                    self.tables.drop(h)
                return node.query, {}
            self.refresh(Node(hidden, place(text), node.mode))
            made += [str(hidden)] if alias in new else []
        return place(outer), {str(n): str(h) for n, h in names.items()}

    def _alone(self, query: str) -> bool:
        """Whether a block can be a table: it reads no columns of the query around it, and its own have different names."""
        try:
            columns = [c.lower() for c in self.frame(query, closed=False).columns]
        except AnalysisException:
            return False
        return len(set(columns)) == len(columns)

    def _fill_plain(self, run: _Run, query: str) -> dict:
        return self.tables.plain(run.node.name, self.frame(query, run.now))

    def _buckets(self, run: _Run) -> int:
        return self.tables.buckets_for(sum(self.tables.bytes_of(self.tables.entry(n, v)) for n, v in run.now.items()))

    # refresh

    def refresh(self, node: Node) -> str:
        """Brings a node up to date; says how: none, full or the rule's kind."""
        for _ in range(TRIES):
            try:
                return self._refresh(node)
            except Conflict:
                continue
        raise Conflict(f"{node.name} is refreshed by others all the time")

    def _refresh(self, node: Node) -> str:
        query, hidden = self._outer(node)
        since, held = self.tables.version(node.name), self.tables.entry(node.name)
        seen, now = (held or {}).get("inputs"), self.inputs(query)
        whole = lambda: self._full(node, query, hidden)
        if seen is None or seen["query"] != node.query or set(seen["versions"]) != set(now):
            return whole()
        if any(str(n) not in now for n in references(self.spark, query)):
            return whole()  # it reads something without versions, whose changes are not known
        if seen["versions"] == now:
            return "none"
        rule = rule_for(self.spark, query) if node.mode != Mode.FULL else _FULL
        if rule.kind == "full":
            return whole()
        changes = {n: self.tables.changes(n, v, now[n]) for n, v in seen["versions"].items() if now[n] != v}
        if any(c is None for c in changes.values()) or not self._known(rule, changes):
            return whole()
        run = _Run(node, rule, now, seen["versions"], {n: c for n, c in changes.items() if c != (None, None)})
        if not run.changes:
            self._commit(run, since, held | {"plus": [], "minus": [], "touched": [], "full": False} if "at" in held else held | {"plus": [], "minus": [], "full": False}, hidden)
            return rule.kind
        kind = rule.kind
        if kind == "sums" and run.removes and self._inexact(held):
            kind = "full" if rule.grouping or not rule.keys or held.get("states") else "groups"
        done = None if kind == "full" else getattr(self, f"_again_{kind}")(run, held)
        if done is None:
            return whole()
        self._commit(run, since, done | {"full": False}, hidden)
        return kind

    def _known(self, rule: Rule, changes: dict) -> bool:
        """Whether the change is what deltas.py takes it for: NOT IN is false or null for all rows once there is a null."""
        for s in (s for b in rule.blocks if b.negated for s in b.subs if s.column):
            column = _bare(s.select.strip())
            for df in (df for p in s.parts for df in changes.get(str(p.name), ()) if df is not None):
                if column not in map(str.lower, df.columns) or not df.where(F.col(column).isNull()).isEmpty():
                    return False
        return True

    # bag

    def _again_bag(self, run: _Run, held: dict) -> dict:
        like = StructType.fromDDL(held["schema"])
        parts = [(s, _cast(df, like)) for b in run.rule.blocks for s, df in self._signed(run, b)]
        a, b = (_union([df for s, df in parts if s == sign]) for sign in (1, -1))
        if a is not None and b is not None:
            a, b = a.exceptAll(b), b.exceptAll(a)
        added, removed = ([] if df is None else self._kept(run, df) for df in (a, b))
        return self.tables.changer(str(run.node.name), added, removed)(held, held["schema"])

    def _kept(self, run: _Run, df: DataFrame) -> list[str]:
        """The folder that rows were written to; none if there are no rows."""
        path = self.tables._write(str(run.node.name), df)
        return [] if self.tables._read([path], _ddl(df)).isEmpty() else [path]

    # sums: a wide table of keys, row counts, sums and non-null counts beside the result's own columns

    def _state(self, run: _Run, calls: list[int] | None = None) -> dict[str, str]:
        """SELECT and GROUP BY of the state."""
        rule = run.rule
        cols = [f"{k} AS mr_k{i}" for i, k in enumerate(rule.keys)] + ["count(*) AS mr_n"]
        arguments = self._over(run, rule.block, select=", ".join([f"{x} AS a{i}" for i, (f, x) in rule.calls.items() if f == "avg"] or ["1"]), group="").schema
        whole = {f.name for f in arguments if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType))}
        for i in rule.calls if calls is None else calls:
            f, x = rule.calls[i]
            if f in ("min", "max"):
                cols.append(f"{f}({x}) AS mr_m{i}")
            elif x != "*" and f != "distinct":
                cols.append(f"count({x}) AS mr_c{i}")
                if f in ("sum", "avg"):
                    cols.append(f"sum({f'CAST({x} AS DECIMAL(38,0))' if f'a{i}' in whole else x}) AS mr_s{i}")
        return {"select": ", ".join(cols), "group": rule.grouping or ", ".join(rule.keys)}

    def _values(self, run: _Run, i: int) -> dict[str, str]:
        """SELECT and GROUP BY of how often each group has each value of an argument."""
        rule, x = run.rule, run.rule.calls[i][1]
        keys = rule.keys[: len(self._value_keys(rule))]
        return {"select": ", ".join([*[f"{k} AS mr_k{j}" for j, k in enumerate(keys)], f"{x} AS mr_v", "count(*) AS mr_n"]), "group": ", ".join([*keys, x])}

    def _counted(self, run: _Run, i: int) -> DataFrame:
        """The same over all rows. They are dealt out before they are counted, since most may have a value of their own and
        Spark holds what it counts of a whole file split."""
        rule = run.rule
        keys = self._value_keys(rule)
        select = ", ".join([*[f"{k} AS {name}" for k, name in zip(rule.keys, keys)], f"{rule.calls[i][1]} AS mr_v"])
        rows = self._over(run, rule.block, _some(rule, i), select=select, group="")
        dealt = rows.withColumn("mr_share", F.xxhash64(*rows.columns)).hint("rebalance", "mr_share")
        return dealt.groupBy(*keys, "mr_v").agg(F.count("*").alias("mr_n"))

    def _value_keys(self, rule: Rule) -> list[str]:
        """Counts of values are those of groups by all the keys; the extremes of grouping sets follow from them."""
        return self._keys(rule)[: -1 if rule.grouping else None]

    @staticmethod
    def _values_of(rule: Rule, i: int) -> str:
        return f"g{i}" if rule.grouping else f"v{i}"

    def _found(self, rule: Rule, i: int, values: DataFrame) -> DataFrame:
        """Keys and what the counts of values say of each group."""
        f, keys = rule.calls[i][0], self._keys(rule)
        if not rule.grouping:
            return values.groupBy(*keys).agg((F.count("mr_v") if f == "distinct" else getattr(F, f)("mr_v")).alias(f"mr_m{i}"))
        names = dict(zip(rule.keys, keys[:-1]))
        kind, of = _SETS.match(rule.grouping).groups()
        of = re.sub(r"[\w.]+", lambda m: names[m[0]], of)
        with _Views(self.spark) as views:
            return self.spark.sql(f"SELECT {', '.join(keys[:-1])}, grouping_id() AS {keys[-1]}, {f}(mr_v) AS mr_m{i} FROM {views.of((i,), lambda: values)} GROUP BY {kind} ({of})")

    @staticmethod
    def _keys(rule: Rule) -> list[str]:
        return [f"mr_k{i}" for i in range(len(rule.keys))]

    def _wide(self, run: _Run, state: DataFrame, values: dict[int, DataFrame], like: StructType) -> DataFrame:
        """The state, with what the counts of values say, and the result's columns."""
        rule, keys = run.rule, self._keys(run.rule)
        for i, df in values.items():
            named = self._found(rule, i, df).toDF(*[f"mr_o{j}" for j in range(len(keys))], f"mr_m{i}")
            state = state.drop(f"mr_m{i}").join(named, _null_safe(state, keys, named, named.columns[:-1]), "left").drop(*named.columns[:-1])
        cols = []
        for i, f in enumerate(like.fields):
            if i not in rule.calls:
                col = F.col(f"mr_k{rule.key_at.index(i)}")
            else:
                call, x = rule.calls[i]
                if call in ("min", "max"):
                    col = F.col(f"mr_m{i}")
                elif call == "distinct":
                    col = F.coalesce(F.col(f"mr_m{i}"), F.lit(0))
                elif call == "count":
                    col = F.coalesce(F.col("mr_n" if x == "*" else f"mr_c{i}"), F.lit(0))
                elif call == "sum":
                    col = F.when(F.col(f"mr_c{i}") > 0, F.col(f"mr_s{i}"))
                else:
                    total = F.col(f"mr_s{i}")
                    exact = state.schema[f"mr_s{i}"].dataType.simpleString() == "decimal(38,0)"
                    col = F.when(F.col(f"mr_c{i}") > 0, (total.cast("double") if exact else total) / F.col(f"mr_c{i}"))
            cols.append(col.cast(f.dataType).alias(f.name))
        own = [c for c in state.columns if c.startswith("mr_")]
        return state.select(*[F.col(c) for c in own], *cols)

    def _visible(self, contents: dict, like: StructType | str) -> dict:
        """Contents whose hidden columns only the refresher reads."""
        return contents | {"wide": contents["schema"], "schema": like if isinstance(like, str) else _ddl(like)}

    def _fill_sums(self, run: _Run, query: str) -> dict:
        rule, keys, n = run.rule, self._keys(run.rule), self._buckets(run)
        like = self.frame(query, run.now).schema
        if any(isinstance(f.dataType, MapType) for f in like.fields):
            return self._fill_plain(run, query)
        states = {f"v{i}": self.tables.bucketed(run.node.name, self._counted(run, i), keys, n) for i in rule.distinct}
        state = self._over(run, rule.block, **self._state(run))
        wide = self._wide(run, state, {i: self.tables.frame(states[f"v{i}"]) for i in rule.distinct}, like)
        return self._visible(self.tables.bucketed(run.node.name, wide, keys, n), like) | {"states": states}

    @staticmethod
    def _inexact(held: dict) -> bool:
        """Whether the state has floating sums: rows cannot be taken out of those again."""
        return any(f.name.startswith("mr_s") and isinstance(f.dataType, (DoubleType, FloatType)) for f in StructType.fromDDL(held.get("wide", held["schema"])).fields)

    def _summed(self, run: _Run, **how) -> DataFrame:
        """The change of a state, signed, summed by its keys and written; a group's other columns are as its rows have them."""
        rule = run.rule
        parts = [df.select(*[(F.col(c) * sign).alias(c) if c[3] in "ncs" else F.col(c) for c in df.columns]) for sign, df in self._signed(run, rule.block, **how)]
        delta = _union(parts)
        return self._scratch(run, delta.groupBy(*[c for c in delta.columns if c[3] in "kv"]).agg(*self._combined(rule, delta.columns)))

    def _combined(self, rule: Rule, columns: list[str], like: StructType | None = None) -> list[Column]:
        out = []
        for c in columns:
            if c[3] in "ncs":
                out.append((F.sum(c).cast(like[c].dataType) if like else F.sum(c)).alias(c))
            elif c[3] == "m":
                out.append(getattr(F, rule.calls[int(c[4:])][0])(c).alias(c) if rule.calls[int(c[4:])][0] != "distinct" else F.max(c).alias(c))
        return out

    def _scratch(self, run: _Run, df: DataFrame) -> DataFrame:
        """df, written once as it is read several times; vacuum removes it."""
        return self.tables._read([self.tables._write(f"{run.node.name}.change", df)], _ddl(df))

    def _touched(self, rows: DataFrame, keys: list[str], n: int) -> list[int]:
        """Buckets of the keys of rows, at most n numbers."""
        return sorted(r[0] for r in rows.select(bucket_of(keys, n).alias("b")).distinct().collect())

    def _merged(self, held: dict, delta: DataFrame, touched: list[int], by: list[str]) -> DataFrame:
        """Counts of values in the touched buckets, with the change's."""
        old = self.tables.frame(held, touched)
        like = old.schema
        return old.unionByName(_cast(delta, like)).groupBy(*by).agg(F.sum("mr_n").cast("long").alias("mr_n")).where("mr_n <> 0")

    def _again_sums(self, run: _Run, held: dict) -> dict | None:
        rule, keys, name = run.rule, self._keys(run.rule), run.node.name
        if "wide" not in held:
            return None
        n, states, wide = len(held["at"]), dict(held.get("states", {})), StructType.fromDDL(held["wide"])
        counted = [i for i in rule.calls if self._values_of(rule, i) in states]
        if run.removes and any(rule.grouping and _reads(rule.calls[i][1], rule.keys[:-1]) for i in rule.extremes):
            return None  # an argument that is null where the grouping leaves a key out
        fresh = [i for i in rule.extremes if run.removes and i not in counted]  # the first removed rows call for counts of values
        delta = self._summed(run, **self._state(run))
        touched = self._touched(delta, keys, n)
        values = {}
        by = self._value_keys(rule)
        for i in [*counted, *fresh]:
            kept = self._values_of(rule, i)
            if i in fresh:
                states[kept] = self.tables.bucketed(name, self._counted(run, i), by, n)
            else:
                change = self._summed(run, also=_some(rule, i), **self._values(run, i))
                those = self._touched(change, by, n) if rule.grouping else touched
                now = self._merged(states[kept], change, those, [*by, "mr_v"])
                states[kept] = self.tables.bucketed(name, now, by, n, states[kept], those)
            values[i] = self.tables.frame(states[kept], None if rule.grouping else touched)
        before = self.tables.frame(held, touched, held["wide"])
        columns = [c for c in wide.names if c.startswith("mr_")]
        lacking = {c for c in columns if c not in delta.columns}  # counts of values give these
        both = before.select(*columns).unionByName(delta.select(*[F.col(c).cast(wide[c].dataType).alias(c) if c not in lacking else F.lit(None).cast(wide[c].dataType).alias(c) for c in columns]))
        after = both.groupBy(*keys).agg(*self._combined(rule, [c for c in columns if c[3] != "k"], wide))
        if keys:
            after = after.where("mr_n > 0")
        like = StructType.fromDDL(held["schema"])
        now = _cast_named(self._wide(run, after, values, like), wide)
        contents = self.tables.bucketed(name, now, keys, n, held, touched)
        return self._visible(contents, held["schema"]) | {"states": states, "touched": touched}

    # sets: how often each row is on each side

    _TIMES = {
        "union": "CAST(n0 + n1 > 0 AS INT)",
        "intersect": "CAST(n0 > 0 AND n1 > 0 AS INT)",
        "intersect all": "CAST(least(n0, n1) AS INT)",
        "except": "CAST(n0 > 0 AND n1 = 0 AS INT)",
        "except all": "CAST(greatest(n0 - n1, 0) AS INT)",
    }

    def _sided(self, run: _Run, frames: list[list[tuple[int, DataFrame]]], like: StructType) -> DataFrame:
        rows = [_cast(df, like).toDF(*_row(like)).select("*", *[F.lit(sign if k == side else 0).cast("long").alias(f"n{k}") for k in (0, 1)]) for side, parts in enumerate(frames) for sign, df in parts]
        return _union(rows).groupBy(*_row(like)).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def _result_of_sides(self, run: _Run, sides: DataFrame, like: StructType) -> DataFrame:
        times = sides.withColumn("mr_times", F.expr(f"sequence(1, {self._TIMES[run.rule.op]})")).where(F.expr(f"{self._TIMES[run.rule.op]} > 0"))
        return times.select(*[F.col(c).alias(f.name) for c, f in zip(_row(like), like.fields)], F.explode("mr_times").alias("mr_i")).drop("mr_i")

    def _fill_sets(self, run: _Run, query: str) -> dict:
        like, n = self.frame(query, run.now).schema, self._buckets(run)
        if any(isinstance(f.dataType, MapType) for f in like.fields) or len(set(like.names)) < len(like.names):
            return self._fill_plain(run, query)
        sides = self._sided(run, [[(1, self._over(run, b))] for b in run.rule.blocks], like)
        state = self.tables.bucketed(run.node.name, sides, _row(like), n)
        result = self.tables.bucketed(run.node.name, self._result_of_sides(run, self.tables.frame(state), like), like.names, n)
        return result | {"states": {"sides": state}}

    def _again_sets(self, run: _Run, held: dict) -> dict | None:
        state = held.get("states", {}).get("sides")
        if state is None:
            return None
        like, n = StructType.fromDDL(held["schema"]), len(held["at"])
        delta = self._scratch(run, self._sided(run, [self._signed(run, b) for b in run.rule.blocks], like))
        touched = self._touched(delta, _row(like), n)
        both = self.tables.frame(state, touched).unionByName(delta)
        sides = both.groupBy(*_row(like)).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 <> 0 OR n1 <> 0")
        state = self.tables.bucketed(run.node.name, sides, _row(like), n, state, touched)
        result = self._result_of_sides(run, self.tables.frame(state, touched), like)
        return self.tables.bucketed(run.node.name, result, like.names, n, held, touched) | {"states": {"sides": state}, "touched": touched}

    # groups and windows: what has touched keys is computed again

    def _keyed(self, run: _Run) -> str:
        return ", ".join([run.rule.block.select, *[f"{k} AS mr_k{i}" for i, k in enumerate(run.rule.keys)]])

    def _fill_groups(self, run: _Run, query: str) -> dict:
        like = self.frame(query, run.now).schema
        rows = self._over(run, run.rule.block, select=self._keyed(run))
        if len(set(like.names)) < len(like.names) or any(isinstance(f.dataType, MapType) for f in like.fields):
            return self._fill_plain(run, query)
        return self._visible(self.tables.bucketed(run.node.name, rows, self._keys(run.rule), self._buckets(run)), like)

    _fill_windows = _fill_groups

    def _only(self, rule: Rule) -> str:
        same = " AND ".join(f"mr_t.mr_k{i} <=> ({k})" for i, k in enumerate(rule.keys))
        return f"EXISTS (SELECT 1 FROM mr_touched mr_t WHERE {same})"

    def _touched_keys(self, run: _Run) -> DataFrame:
        select = "DISTINCT " + ", ".join(f"{k} AS mr_k{i}" for i, k in enumerate(run.rule.keys))
        return self._scratch(run, _union([df for _, df in self._signed(run, run.rule.block, select=select, group="", having="")]).distinct())

    def _again_groups(self, run: _Run, held: dict) -> dict | None:
        if "wide" not in held:
            return None
        rule, keys, n, wide = run.rule, self._keys(run.rule), len(held["at"]), StructType.fromDDL(held["wide"])
        touched_keys = self._touched_keys(run)
        touched = self._touched(_cast_named(touched_keys, StructType([wide[k] for k in keys])), keys, n)
        before = self.tables.frame(held, touched, held["wide"])
        rest = before.join(touched_keys, _null_safe(before, keys, touched_keys, keys), "left_anti")
        if rule.kind == "sums":
            state = self._over(run, rule.block, self._only(rule), {"mr_touched": touched_keys}, **self._state(run))
            again = self._wide(run, state, {}, StructType.fromDDL(held["schema"]))
        else:
            again = self._over(run, rule.block, self._only(rule), {"mr_touched": touched_keys}, select=self._keyed(run))
        now = rest.unionByName(_cast(again, wide) if rule.kind != "sums" else _cast_named(again, wide))
        return self._visible(self.tables.bucketed(run.node.name, now, keys, n, held, touched), held["schema"]) | {"touched": touched} | ({"states": {}} if rule.kind == "sums" else {})

    _again_windows = _again_groups

    # top: the first rows in order and a reserve

    @staticmethod
    def _order(rule: Rule, visible: list[str]) -> tuple[str, str]:
        """SELECT of the rows with what they are ordered by, and ORDER BY in terms of that.

        A name or place in the SELECT list is that column; anything else is a hidden column."""
        select, order, names = [rule.block.select], [], {c.lower(): c for c in visible}
        for i, item in enumerate(listed(rule.order)):
            text, way = re.fullmatch(r"(?is)(.*?)((?:\s+(?:asc|desc))?(?:\s+nulls\s+(?:first|last))?)", item.strip()).groups()
            text = text.replace("`", "") if re.fullmatch(r"`\w+`", text) else text
            if text.isdigit() and 0 < int(text) <= len(visible):
                text = visible[int(text) - 1]
            if text.lower() in names:
                order.append(f"`{names[text.lower()]}`{way}")
            else:
                select.append(f"{text} AS mr_o{i}")
                order.append(f"mr_o{i}{way}")
        return ", ".join(select), ", ".join(order)

    def _ordered(self, df: DataFrame, order: str, n: int) -> DataFrame:
        with _Views(self.spark) as views:
            return self.spark.sql(f"SELECT * FROM {views.of(('rows',), lambda: df)} ORDER BY {order} LIMIT {n}")

    def _fill_top(self, run: _Run, query: str) -> dict:
        visible = self._over(run, run.rule.block).columns
        select, order = self._order(run.rule, visible)
        try:
            rows = self._over(run, run.rule.block, select=select)
        except AnalysisException:  # ordered by an expression over names of the SELECT list
            return self._fill_plain(run, query)
        if len({c.lower() for c in visible}) < len(visible):
            return self._fill_plain(run, query)
        m = 2 * run.rule.limit + RESERVE
        state = self.tables.plain(run.node.name, self._ordered(rows, order, m))
        held = self.tables.frame(state)
        state["all"] = held.count() < m  # then it has every row there is
        result = self.tables.plain(run.node.name, self._ordered(held, order, run.rule.limit).select(*_quoted(visible)))
        return result | {"states": {"reserve": state}}

    def _again_top(self, run: _Run, held: dict) -> dict | None:
        """Rows beyond the last one of the reserve are not known and not taken in; they come back with a refill."""
        state = held.get("states", {}).get("reserve")
        if state is None:
            return None
        visible = StructType.fromDDL(held["schema"]).names
        select, order = self._order(run.rule, visible)
        parts = self._signed(run, run.rule.block, select=select)
        reserve, m, k = self.tables.frame(state), 2 * run.rule.limit + RESERVE, run.rule.limit
        like = reserve.schema
        plus, minus = (_union([_cast(df, like) for s, df in parts if s == sign]) for sign in (1, -1))
        if plus is not None and minus is not None:
            plus, minus = plus.exceptAll(minus), minus.exceptAll(plus)
        rows = reserve.exceptAll(minus) if minus is not None else reserve
        rows = rows if plus is None else rows.unionByName(self._ordered(plus, order, m))
        if not state["all"]:
            marked = reserve.withColumn("mr_now", F.lit(0)).unionByName(rows.withColumn("mr_now", F.lit(1)))
            with _Views(self.spark) as views:  # over 4 * limit + 2 * RESERVE rows at most
                rows = self.spark.sql(
                    f"SELECT * FROM (SELECT *, max(CASE WHEN mr_now = 0 THEN mr_rank END) OVER () AS mr_edge FROM "
                    f"(SELECT *, rank() OVER (ORDER BY {order}) AS mr_rank FROM {views.of(('rows',), lambda: marked)})) "
                    f"WHERE mr_now = 1 AND mr_rank <= mr_edge"
                ).select(*like.names)
        kept = self.tables.plain(run.node.name, self._ordered(rows, order, m))
        n = self.tables.frame(kept).count()
        kept["all"] = state["all"] and n < m
        if not kept["all"] and n < k:
            return None
        now = self.tables.plain(run.node.name, self._ordered(self.tables.frame(kept), order, k).select(*_quoted(visible)))
        a, b = self.tables.frame(now), self.tables.frame(held)
        added, removed = self._kept(run, a.exceptAll(b)), self._kept(run, b.exceptAll(a))
        return now | {"plus": added, "minus": removed, "states": {"reserve": kept}}

    # closure: rounds of a recursion, each from the rows that the last one found

    def _round(self, run: _Run, rows: DataFrame, versions: dict[str, int], like: StructType) -> DataFrame:
        """What the step makes of rows."""
        step = run.rule.blocks[1]
        with _Views(self.spark) as views:
            names = [views.of(("rows",), lambda: rows) if str(n) == run.rule.op else self._view(views, n, versions[str(n)]) for n in step.tables]
            return _cast(self.spark.sql(step.sql(names)), like)

    def _closed(self, run: _Run, have: list[str], first: DataFrame, versions: dict[str, int], like: StructType, within: DataFrame | None = None, most: int | None = None) -> list[str] | None:
        """Folders of the rows that follow from the first ones, these included, and are not in `have`; each round is written.

        None as soon as there are more than `most`. What a failed refresh has written for the same inputs is not written again."""
        key = (str(run.node.name), run.node.query, repr((have, versions, run.old, run.now, within is None, most)))
        out = self._rounds.setdefault(key, [])
        read = lambda paths: self.tables._read(paths, _ddl(like))
        if any(not self.tables.files.names(p.removeprefix(f"{self.tables.files.root}/")) for p in out):
            out.clear()  # vacuum took them
        sizes = [read([p]).count() for p in out]
        n_have, n_within = (read(have).count() if have else 0), (within.count() if within is not None else 0)
        while True:
            if most is not None and sum(sizes) > most:
                self._rounds.pop(key)
                return None
            if out:
                first = self._round(run, _by_rows(read(out[-1:]), sizes[-1]), versions, like)
            new = first.distinct() if within is None else _matched(first.distinct(), within, n_within, "left_semi")
            path = self.tables._write(str(run.node.name), _matched(new, read(have + out), n_have + sum(sizes), "left_anti") if have or out else new)
            n = read([path]).count()
            if not n:
                return self._rounds.pop(key)
            out.append(path)
            sizes.append(n)

    def _start(self, run: _Run, like: StructType | None = None) -> DataFrame:
        df = self._over(run, run.rule.blocks[0])
        return _cast(df, like) if like else df.toDF(*run.rule.keys) if run.rule.keys else df

    def _fill_closure(self, run: _Run, query: str) -> dict:
        first = self._start(run)
        like = first.schema
        return {"paths": self._closed(run, [], first, run.now, like), "schema": _ddl(like)}

    def _moved(self, run: _Run, rows: DataFrame, like: StructType) -> dict[int, DataFrame | None]:
        """What the changes add (1) and take away (-1) at the start and in one step from rows."""
        start, step = run.rule.blocks
        parts = self._signed(run, start)
        with _Views(self.spark) as views:

            def view(name: Name, role: str) -> str | None:
                key = str(name)
                if key == run.rule.op:
                    return views.of((key,), lambda: rows)
                if role in ("new", "old"):
                    return self._view(views, name, (run.now if role == "new" else run.old)[key])
                df = run.changes[key][role == "minus"]
                return None if df is None else views.of((key, role), lambda: df)

            parts += [(sign, self.spark.sql(text)) for sign, text in step.signed(set(run.changes), view)]
        return {s: _union([_cast(df, like) for sign, df in parts if sign == s]) for s in (1, -1)}

    def _again_closure(self, run: _Run, held: dict) -> dict:
        like, paths = StructType.fromDDL(held["schema"]), held["paths"]
        rows = self.tables.frame(held)
        moved = self._moved(run, rows, like)
        if moved[-1] is None:
            added = self._closed(run, paths, moved[1], run.now, like) if moved[1] is not None else []
            return {"paths": paths + added, "schema": held["schema"], "plus": added, "minus": [], "full": False}
        n = rows.count()
        gone = self._closed(run, [], moved[-1], run.old, like, within=rows, most=n // DOUBTFUL)
        if gone is None:  # looking at all of them again is less work
            found = self._closed(run, [], self._start(run, like), run.now, like)
            now = self.tables._read(found, _ddl(like))
            added, removed = (self._kept(run, _matched(a, b, n, "left_anti")) for a, b in ((now, rows), (rows, now)))
            return {"paths": found, "schema": held["schema"], "plus": added, "minus": removed, "full": False}
        doubtful = self.tables._read(gone, _ddl(like))
        stay = self._kept(run, _matched(rows, doubtful, doubtful.count(), "left_anti"))
        left = self.tables._read(stay, _ddl(like))
        again = self._start(run, like).unionByName(self._round(run, _by_rows(left, n), run.now, like))
        found = self._closed(run, stay, again, run.now, like)
        now = self.tables._read(stay + found, _ddl(like))
        added, removed = self._kept(run, _matched(now, rows, n, "left_anti")), self._kept(run, _matched(doubtful, now, n, "left_anti"))
        return {"paths": stay + found, "schema": held["schema"], "plus": added, "minus": removed, "full": False}

    # definitions that change

    def evolve(self, node: Node, old_query: str) -> str:
        """Contents for a query with columns added or removed at the end, where the node is up to date.

        Removed columns are no longer shown; added aggregates are computed alone and joined to the state by key."""
        held = self.tables.entry(node.name)
        seen, now = (held or {}).get("inputs"), self.inputs(node.query)
        rule, was = rule_for(self.spark, node.query), rule_for(self.spark, old_query)
        if seen is None or seen["versions"] != now or node.mode == Mode.FULL or rule.kind != "sums" or was.kind != "sums" or "wide" not in held or rule.key_at != was.key_at or rule.keys != was.keys:
            return self.full(node)
        run = _Run(node, rule, now)
        like, since = self.frame(node.query, now).schema, self.tables.version(node.name)
        if len(rule.calls) <= len(was.calls):
            gone = {f"v{i}" for i in was.calls if i not in rule.calls}
            entry = held | {"schema": _ddl(like), "states": {k: v for k, v in held.get("states", {}).items() if k not in gone}}
        else:
            more = [i for i in rule.calls if i not in was.calls]
            if set(more) & set(rule.distinct):
                return self.full(node)
            keys = self._keys(rule)
            added = self._over(run, rule.block, **self._state(run, more)).drop("mr_n")
            added = added.toDF(*[f"mr_o{c[4:]}" if c.startswith("mr_k") else c for c in added.columns])
            state = self.tables.frame(held, schema=held["wide"])
            state = state.select(*[c for c in state.columns if c.startswith("mr_")])
            joined = state.join(added, _null_safe(state, keys, added, [f"mr_o{i}" for i in range(len(keys))]), "left").drop(*[f"mr_o{i}" for i in range(len(keys))])
            wide = self._wide(run, joined, {}, like)
            entry = self._visible(self.tables.bucketed(node.name, wide, keys, len(held["at"])), like) | {"states": held.get("states", {})}
        self._commit(run, since, {k: v for k, v in entry.items() if k not in ("plus", "minus", "touched")} | {"full": True}, {})
        return "in-place"


def _reads(text: str, keys: list[str]) -> bool:
    """Whether an expression has one of the names."""
    return bool({_bare(t) for t in tokens(text)} & {_bare(k) for k in keys})


def _some(rule: Rule, i: int) -> str:
    return f"({rule.calls[i][1]}) IS NOT NULL"


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _row(like: StructType) -> list[str]:
    """Names for the columns of a row that clash with none."""
    return [f"c{i}_" for i in range(len(like.fields))]


def _ddl(of) -> str:
    schema = of if isinstance(of, StructType) else of.schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _cast(df: DataFrame, like: StructType) -> DataFrame:
    """df with names and types of another, by place."""
    own = [f"mr_p{i}" for i in range(len(df.columns))]
    return df.toDF(*own).select(*[F.col(a).cast(f.dataType).alias(f.name) for a, f in zip(own, like.fields)])


def _cast_named(df: DataFrame, like: StructType) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.fields])


def _by_rows(df: DataFrame, n: int) -> DataFrame:
    """df of n rows in files, which Spark is not to broadcast for their small size when they are many."""
    return df.hint("merge") if n > BROADCAST_ROWS else df


def _matched(a: DataFrame, b: DataFrame, n: int, how: str) -> DataFrame:
    """Rows of a that b, of n rows, has too (left_semi) or has not (left_anti); nulls are equal."""
    own, named = a.toDF(*[f"mr_a{i}" for i in range(len(a.columns))]), b.toDF(*[f"mr_b{i}" for i in range(len(b.columns))])
    return own.join(_by_rows(named, n), _null_safe(own, own.columns, named, named.columns), how).toDF(*a.columns)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def _null_safe(a: DataFrame, left: list[str], b: DataFrame, right: list[str]):
    on = F.lit(True)
    for x, y in zip(left, right):
        on = on & a[x].eqNullSafe(b[y])
    return on

"""Facts about a query from Catalyst's unresolved plan.

Spark's own parser does the parsing; its plan is read as JSON in one call.
Only this module depends on that form.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import SparkSession

from ..errors import IvmUnsupportable, SqlParseError, UntrustedSql
from ..model import Name

#: Functions whose result may differ between two runs over the same rows.
VOLATILE = (
    "random", "gen_random_uuid", "uuid_generate_v4", "now", "clock_timestamp", "timeofday", "transaction_timestamp",
    "statement_timestamp", "localtime", "localtimestamp", "current_timestamp", "current_time", "current_date",
    "pg_sleep", "nextval", "lastval", "currval",
)
#: The same in Spark's own names.
VOLATILE_SPARK = ("rand", "randn", "randstr", "uuid", "shuffle", "uniform", "monotonically_increasing_id", "spark_partition_id", "input_file_name")
AGGREGATES = ("sum", "count", "min", "max", "avg", "mean")


@dataclass
class Item:
    """An entry of the SELECT list: canonical text without its alias, and the alias."""

    text: str
    alias: str | None
    function: str | None = None  # a lone aggregate function
    distinct: bool = False


@dataclass
class Shape:
    relations: list[Name] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    clauses: dict[str, str] = field(default_factory=dict)  # everything but the SELECT list, canonical
    set_op: str | None = None
    distinct: bool = False
    grouped: bool = False
    functions: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    nested: bool = False  # subqueries, WITH, windows, HAVING, ORDER BY, LIMIT: not just select, join, filter, group
    command: str | None = None

    @property
    def volatile(self) -> list[str]:
        return [f for f in self.functions if f in VOLATILE or f in VOLATILE_SPARK]


def _tree(flat: list[dict]) -> dict:
    """The tree of a pre-order list of nodes."""
    it = iter(flat)

    def node() -> dict:
        n = dict(next(it))
        n["children"] = [node() for _ in range(n.pop("num-children"))]
        return n

    return node()


def _is_flat(x) -> bool:
    return isinstance(x, list) and bool(x) and isinstance(x[0], dict) and "num-children" in x[0]


def _kind(n: dict) -> str:
    return n["class"].rsplit(".", 1)[-1]


def _parts(text: str) -> list[str]:
    return [p.strip() for p in text.strip("[]").split(",")]


_SKIP = {"exprId", "nonInheritableMetadataKeys", "num-children", "isInternal", "origin", "jvmId", "options", "hint", "outerAttrs", "joinCond", "numCols", "dataType"}


def _canonical(x) -> object:
    """Trees without what differs from one parse to the next; unquoted names in lower case."""
    if _is_flat(x):
        return _canonical(_tree(x))
    if isinstance(x, list):
        return [_canonical(y) for y in x]
    if isinstance(x, dict):
        out = {k: _canonical(v) for k, v in x.items() if k not in _SKIP}
        if "nameParts" in out:
            out["nameParts"] = str(out["nameParts"]).lower()
        if "multipartIdentifier" in out:
            out["multipartIdentifier"] = str(out["multipartIdentifier"]).lower()
        return out
    return x


def _text(x) -> str:
    return json.dumps(_canonical(x), sort_keys=True)


def _walk(x):
    """All plan and expression nodes below x."""
    if _is_flat(x):
        for n in x:
            yield n
            for k, v in n.items():
                if k != "class":
                    yield from _walk(v)
    elif isinstance(x, list):
        for y in x:
            yield from _walk(y)
    elif isinstance(x, dict):
        for v in x.values():
            yield from _walk(v)


@lru_cache(maxsize=4096)
def _plan(spark: SparkSession, sql: str) -> str:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()


def parsed(spark: SparkSession, sql: str, what: str = "query") -> list[dict]:
    try:
        return json.loads(_plan(spark, sql))
    except Exception as e:
        first = next((line for line in str(getattr(e, "desc", None) or e).splitlines() if line.strip()), "")
        raise SqlParseError(f"{what}: {first}") from e


def shape(spark: SparkSession, sql: str, what: str = "query") -> Shape:
    flat = parsed(spark, sql, what)
    out = Shape()
    ctes: set[str] = set()
    for n in _walk(flat):
        k = _kind(n)
        if k == "UnresolvedWith":
            ctes |= {r[0] if isinstance(r, list) else r.get("_1", "") for r in n.get("cteRelations", []) if r}
            out.nested = True
        elif k == "UnresolvedRelation":
            parts = _parts(n["multipartIdentifier"])
            if len(parts) <= 2:
                name = Name(parts[0], parts[1]) if len(parts) == 2 else Name.parse(parts[0])
                if name not in out.relations:
                    out.relations.append(name)
        elif k == "UnresolvedFunction":
            out.functions.append(_parts(n["nameParts"])[-1].lower())
        elif k in ("CurrentDate", "CurrentTimestamp", "CurrentTime", "LocalTimestamp", "Now", "Rand", "Uuid"):
            out.functions.append({"CurrentDate": "current_date", "CurrentTimestamp": "current_timestamp", "CurrentTime": "current_time", "LocalTimestamp": "localtimestamp", "Now": "now", "Rand": "rand", "Uuid": "uuid"}[k])
        elif k == "UnresolvedAttribute" and _parts(n["nameParts"])[-1].lower() in ("current_date", "current_timestamp", "current_time", "localtime", "localtimestamp"):
            out.functions.append(_parts(n["nameParts"])[-1].lower())
        elif k in ("ListQuery", "Exists", "ScalarSubquery", "UnresolvedWindowExpression", "WindowExpression", "LateralSubquery", "UnresolvedSubqueryColumnAliases"):
            out.nested = True
        elif k == "Join":
            out.joins.append(n["joinType"]["object"].rsplit(".", 1)[-1].rstrip("$") if isinstance(n["joinType"], dict) and "object" in n["joinType"] else _text(n["joinType"]))
    names = {_cte_name(r) for n in flat if _kind(n) == "UnresolvedWith" for r in n.get("cteRelations", [])} | {c for c in ctes if isinstance(c, str)}
    out.relations = [r for r in out.relations if not (r.schema == "public" and r.name in names)]
    _decompose(_tree(flat), out)
    return out


def _cte_name(relation) -> str:
    """A WITH entry is a tuple of name, plan, depth; the name also is its alias."""
    for n in _walk(relation if isinstance(relation, list) else list(relation.values())):
        if _kind(n) == "SubqueryAlias":
            return n["identifier"]["name"]
    return ""


def _decompose(n: dict, out: Shape) -> None:
    order = []
    while True:
        k = _kind(n)
        if k == "UnresolvedWith":
            out.clauses["with"] = _text(n["cteRelations"])
        elif k in ("GlobalLimit", "LocalLimit", "Offset", "Sort", "UnresolvedHaving"):
            own = {f: v for f, v in n.items() if f not in ("children", "child", "class", "num-children")}
            out.clauses[{"UnresolvedHaving": "having"}.get(k, k.lower())] = _text(own)
            out.nested = True
            order.append(k)
        elif k == "Distinct":
            out.distinct = True
            out.clauses["distinct"] = "yes"
        else:
            break
        n = n["children"][0]
    if k in ("Union", "Intersect", "Except", "SetOperation"):
        out.set_op = k.lower()
        out.clauses["set"] = _text(n)
        return
    if k in ("Project", "Aggregate"):
        lists = n["projectList"] if k == "Project" else n["aggregateExpressions"]
        out.items = [_item(x) for x in lists]
        if k == "Aggregate":
            out.grouped = True
            out.clauses["group"] = _text(n["groupingExpressions"])
        elif any(i.function for i in out.items):
            out.grouped = True
        below = n["children"][0]
        if _kind(below) == "Filter":
            out.clauses["where"] = _text(below["condition"])
            below = below["children"][0]
        out.clauses["from"] = _text(below)
        if _inner_query(below):
            out.nested = True
        return
    if k in ("OneRowRelation", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation"):
        out.clauses["from"] = _text(n)
        return
    out.command = k


def _inner_query(n: dict) -> bool:
    return _kind(n) in ("Project", "Aggregate", "Distinct", "Union", "UnresolvedTableValuedFunction", "Generate", "Pivot", "Unpivot") or any(map(_inner_query, n["children"]))


def _item(flat: list[dict]) -> Item:
    top = _tree(flat)
    alias = None
    if _kind(top) == "Alias":
        alias, top = top["name"], top["children"][0]
    elif _kind(top) == "UnresolvedAlias":
        top = top["children"][0]
    function = _parts(top["nameParts"])[-1].lower() if _kind(top) == "UnresolvedFunction" else None
    inner = any(_kind(x) == "UnresolvedFunction" and _parts(x["nameParts"])[-1].lower() in AGGREGATES for x in _nodes(top))
    return Item(_text(top), alias, function if function in AGGREGATES else ("expression" if inner else None), bool(top.get("isDistinct")))


def _nodes(n: dict):
    yield n
    for c in n["children"]:
        yield from _nodes(c)


@lru_cache(maxsize=4096)
def _references(spark: SparkSession, sql: str) -> tuple[Name, ...]:
    try:
        return tuple(shape(spark, sql).relations)
    except SqlParseError:
        return ()


def references(spark: SparkSession, sql: str) -> list[Name]:
    """Tables that a query reads, in order of appearance; a query that does not parse reads none."""
    return list(_references(spark, sql))


def check_query(spark: SparkSession, sql: str, what: str) -> Shape:
    s = shape(spark, sql, what)
    if s.distinct and "on" in s.functions:  # Spark's parser takes DISTINCT ON (..) for a call of a function ON
        raise SqlParseError(f"{what}: DISTINCT ON is not known to Spark; number the rows of a group and keep the first")
    return s


def check_ivm(spark: SparkSession, sql: str, what: str) -> Shape:
    """Refuses what cannot be maintained from changes."""
    s = check_query(spark, sql, what)
    refuse = lambda why: IvmUnsupportable(f"{what}: {why}")
    if s.command:
        raise refuse("not a query")
    if s.distinct:
        raise refuse("SELECT DISTINCT")
    if s.set_op:
        raise refuse(f"set operation {s.set_op.upper()}")
    if s.volatile:
        raise refuse(f"volatile function {s.volatile[0]}()")
    return s


def check_consumer(spark: SparkSession, sql: str, what: str) -> None:
    """A view body must be one query and nothing else."""
    try:
        s = shape(spark, sql, what)
    except SqlParseError as e:
        kind = (re.match(r"\s*(\w+)", sql) or [None, ""])[1].upper()
        if kind in ("CREATE", "DROP", "ALTER", "TRUNCATE", "INSERT", "UPDATE", "DELETE") or ";" in sql:
            raise UntrustedSql(f"{what}: {kind or 'several statements'} is not allowed in a view body") from e
        raise
    if s.command:
        raise UntrustedSql(f"{what}: {(re.match(r'\s*(\w+)', sql) or [None, 'statement'])[1].upper()} is not allowed in a view body")


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*(?:\s*\.\s*[A-Za-z_][A-Za-z0-9_]*)*|\d[\w.]*|\s+|.", re.S)


def tokens(sql: str) -> list[str]:
    """Strings, comments, dotted names, numbers, white space and single characters; they join to the text."""
    return _TOKEN.findall(sql)


def normalised(sql: str) -> str:
    """White space and comments as one blank, words in lower case; literals as they are."""
    out: list[str] = []
    for t in tokens(sql.strip().rstrip(";")):
        if t.isspace() or t.startswith(("--", "/*")):
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(t if t[0] in "'\"`" else t.lower())
    return "".join(out).strip()


def relocate(sql: str, rename) -> str:
    """The query with every table name in FROM or JOIN replaced by rename(name, k), k counting its uses; None keeps it."""
    out, uses, depth, stack, expect = [], {}, 0, [], False
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith(?:\s+recursive)?|,)\s+([A-Za-z_]\w*)\s*(?:\([^)]*\)\s*)?as\s*\(", sql)}
    in_from: dict[int, bool] = {}
    for t in tokens(sql):
        low = t.lower()
        if t == "(":
            depth += 1
            stack.append(expect)
            expect = False
            in_from[depth] = False
        elif t == ")":
            in_from.pop(depth, None)
            depth -= 1
            if stack:
                stack.pop()
            expect = False
        elif low in ("from", "join"):
            expect = in_from[depth] = True
        elif low in ("where", "group", "having", "order", "limit", "union", "intersect", "except", "select", "on", "using", "window"):
            expect = False
            if low != "on" and low != "using":
                in_from[depth] = False
        elif t == "," and in_from.get(depth):
            expect = True
        elif expect and re.match(r"[A-Za-z_`\"]", t):
            parts = [p.strip() for p in t.replace("`", "").split(".")]
            if len(parts) <= 2 and parts[-1].lower() not in ("lateral", "values") and not (len(parts) == 1 and low in ctes):
                name = Name(*parts) if len(parts) == 2 else Name.parse(parts[0])
                k = uses[name] = uses.get(name, 0) + 1
                new = rename(name, k - 1)
                out.append(f"{new} AS {parts[-1]}" if new else t)
                expect = False
                continue
            expect = False
        out.append(t)
    return _OWN_ALIAS.sub(r"\1\2", "".join(out))


#: A renamed table takes its own name as alias, unless the query gives one.
_OWN_ALIAS = re.compile(r"(\bmr_\w+) AS \w+(\s+(?:(?i:AS)\s+)?(?!(?i:on|using|where|group|having|order|limit|union|intersect|except|join|inner|left|right|full|cross|natural|semi|anti|lateral|tablesample|window)\b)[A-Za-z_]\w*)")


def clause_texts(sql: str) -> dict[str, str]:
    """Texts of the clauses of a plain SELECT, cut at keywords outside brackets and literals."""
    out: dict[str, list[str]] = {}
    depth, now, parts = 0, None, [t for t in tokens(sql.strip().rstrip(";")) if not t.startswith(("--", "/*"))]
    i = 0
    while i < len(parts):
        t, low = parts[i], parts[i].lower()
        depth += (t == "(") - (t == ")")
        if depth == 0 and low in ("select", "from", "where", "group", "having", "order", "limit"):
            if low in ("group", "order"):
                while parts[i].lower() != "by":
                    i += 1
                low += " by"
            now = low
            out[now] = []
        elif now:
            out[now].append(t)
        i += 1
    return {k: "".join(v).strip() for k, v in out.items()}


def listed(text: str) -> list[str]:
    """Entries of a comma-separated list, cut outside brackets and literals."""
    out, depth, now = [], 0, []
    for t in tokens(text):
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(t)
    return [*out, "".join(now).strip()] if "".join(now).strip() else out

"""The registered queries of the table-graph engine, each with the same result in plain SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fmt
from .model import Name, Node, State
from .operators.project import Project
from .plans import classify, cost, dag, planner
from .plans.diff import NodeChange
from .plans.shape import check_consumer, check_ivm, references
from .sources import project as files
from .sources.config import in_window, seconds
from .sources.storage import scratch

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def project(spark: SparkSession, sf_dir: str, nodes: dict[str, str], skip: tuple[str, ...] = ()) -> Project:
    """A project over the tables of sf_dir that its nodes read."""
    p = Project(spark, "driver").init()
    p.define({f"streams/{n}.sql": t if t.startswith("-- @") else t for n, t in nodes.items()})
    for source in {str(d) for n in p._desired.nodes for d in n.depends_on} - {str(n.name) for n in p._desired.nodes}:
        if source not in skip:
            p.attach(source, f"{sf_dir}/{source.split('.', 1)[1]}.parquet")
    return p


# Whole refresh: one node each

NODES = {
    "node_sum_count": "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey",
    "node_min_max": "SELECT o_custkey, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders GROUP BY o_custkey",
    "node_avg": "SELECT user_id, ROUND(AVG(value), 4) AS avg_value, COUNT(*) AS n FROM events GROUP BY user_id",
    "node_global_count_distinct": "SELECT COUNT(DISTINCT event_type) AS kinds FROM events",
    "node_global_sum": "SELECT COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events",
    "node_join_group": "SELECT c.c_custkey, c.c_name, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name",
    "node_join_residual": "SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 25",
    "node_join_using": "SELECT a.c_custkey, ROUND(a.c_acctbal, 2) AS bal, b.c_mktsegment FROM customer a JOIN customer b USING (c_custkey) WHERE a.c_acctbal > 5000",
    "node_left_join": "SELECT n.n_name, COUNT(s.s_suppkey) AS suppliers FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name",
    "node_comma_join": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "node_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "node_computed": "SELECT p_partkey, p_size * 2 AS twice, COALESCE(NULLIF(p_brand, 'x'), 'none') AS brand, CAST(FLOOR(p_retailprice) AS BIGINT) AS price FROM part WHERE p_size BETWEEN 5 AND 20",
    "node_case_tiers": "SELECT o_custkey, CASE WHEN SUM(o_totalprice) > 2000000 THEN 'gold' WHEN SUM(o_totalprice) > 1000000 THEN 'silver' ELSE 'base' END AS tier FROM orders GROUP BY o_custkey",
    "node_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "node_group_ordinal": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1",
    "node_conditional_sum": "SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders GROUP BY o_orderpriority",
    "node_derived": "SELECT d.k, d.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10",
    "node_cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "node_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "node_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "node_window": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "node_rollup": "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "node_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "node_distinct_full": "SELECT DISTINCT o_custkey FROM orders",
    "node_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "node_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "node_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "node_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "node_constant": "SELECT 1 AS one, 'x' AS letter",
    "node_rank": "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "node_lag_lead": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_id FROM events",
    "node_first_last": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lo, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi FROM orders",
    "node_running_sum": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events",
    "node_right_join": "SELECT r.r_name, n.n_name FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 12",
    "node_full_join": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey AND c.c_acctbal > 5000",
    "node_cross_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "node_anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "node_cube": "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)",
    "node_grouping_sets": "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())",
    "node_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "node_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "node_dates": "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(o_orderdate AS DATE) AS d FROM orders",
    "node_strings": "SELECT c_custkey, UPPER(SUBSTRING(c_name, 1, 8)) AS head, LENGTH(TRIM(c_mktsegment)) AS n, CONCAT(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR(9))) AS tag, REPLACE(c_name, '#', '_') AS plain FROM customer",
    "node_math": "SELECT p_partkey, ABS(p_size - 25) AS away, MOD(p_size, 7) AS rest, GREATEST(p_size, 10) AS at_least, LEAST(p_size, 40) AS at_most, SIGN(p_size - 25) * 1.0 AS side FROM part",
}
FULL_ONLY = ("node_distinct_full", "node_union", "node_union_all", "node_intersect", "node_except", "node_except_all", "node_intersect_all")


def _one(name: str, text: str):
    spark_text = text.replace("::BIGINT", "")
    head = "-- @m:refresh_mode = FULL\n" if name in FULL_ONLY else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, {"q": head + spark_text})
        p.apply()
        return p.read("q")

    return run


for _name, _text in NODES.items():
    query(_name, _text)(_one(_name, _text))

#: Functions that the two dialects name differently: the node, and the same in plain SQL.
FAMILIES = {
    "node_arrays": (
        "SELECT o_orderkey, SIZE(SPLIT(o_orderpriority, '-')) AS parts, ELEMENT_AT(SPLIT(o_orderpriority, '-'), 1) AS head FROM orders",
        "SELECT o_orderkey, len(string_split(o_orderpriority, '-'))::INTEGER AS parts, string_split(o_orderpriority, '-')[1] AS head FROM orders",
    ),
    "node_map": (
        "SELECT o_orderkey, ELEMENT_AT(MAP(o_orderstatus, o_custkey), 'F') AS done_by FROM orders",
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS done_by FROM orders",
    ),
    "node_json": (
        "SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "node_date_parts": (
        "SELECT DATE_FORMAT(o_orderdate, 'yyyy-MM') AS month, COUNT(*) AS n, MAX(DAYOFYEAR(o_orderdate)) AS latest FROM orders GROUP BY DATE_FORMAT(o_orderdate, 'yyyy-MM')",
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, MAX(dayofyear(o_orderdate))::INTEGER AS latest FROM orders GROUP BY 1",
    ),
}
for _name, (_text, _sql) in FAMILIES.items():
    query(_name, _sql)(_one(_name, _text))

CHAIN = {
    "lvl1": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
    "lvl2": "SELECT o_orderpriority, SUM(o_totalprice) AS total, COUNT(*) AS n FROM lvl1 GROUP BY o_orderpriority",
    "lvl3": "SELECT COUNT(DISTINCT o_orderpriority) AS kinds, SUM(n) AS n FROM lvl2",
}


@query("node_chain3", "SELECT COUNT(DISTINCT o_orderpriority) AS kinds, COUNT(*) AS n FROM orders")
def node_chain3(spark, sf_dir):
    p = project(spark, sf_dir, CHAIN)
    p.apply()
    return p.read("lvl3")


DIAMOND = {
    "a": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "b": "SELECT o_custkey, COUNT(*) AS n FROM a GROUP BY o_custkey",
    "c": "SELECT o_custkey, MAX(o_totalprice) AS top FROM a GROUP BY o_custkey",
    "d": "SELECT b.o_custkey, b.n, c.top FROM b JOIN c ON b.o_custkey = c.o_custkey",
}


@query("diamond", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey")
def diamond(spark, sf_dir):
    p = project(spark, sf_dir, DIAMOND)
    p.apply()
    return p.read("d")


# Refresh from changes: built on a part, the rest appended or deleted, then refreshed


def changed(nodes: dict[str, str], source: str, first: str, more: str | None = None, less: str | None = None, read: str = "q", kinds: tuple[str, ...] = (), rounded: tuple[str, ...] = (), digits: int = 2):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, nodes, (f"public.{source}",))
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        p.attach(source, rows.where(first))
        p.apply()
        if more:
            p.append(source, rows.where(more))
            done = p.refresh()
        if less:
            p.delete(source, rows.where(less))
            done = p.refresh()
        if kinds and set(done.values()) - set(kinds):
            raise AssertionError(f"refreshed as {done}")
        out = p.read(read)
        return out.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else out

    return run


_EVEN, _ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
_SUM = "SELECT o_custkey, SUM(o_totalprice) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey"
query("ivm_insert_sum", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey")(changed({"q": _SUM}, "orders", _EVEN, _ODD, kinds=("sums",), rounded=("total",)))
query("ivm_delete_sum", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM orders WHERE NOT o_orderkey % 3 = 0 GROUP BY o_custkey")(changed({"q": _SUM}, "orders", "true", less="o_orderkey % 3 = 0", kinds=("groups",), rounded=("total",)))
query("ivm_insert_avg", "SELECT user_id, ROUND(AVG(value), 6) AS avg_value FROM events GROUP BY user_id")(changed({"q": "SELECT user_id, AVG(value) AS avg_value FROM events GROUP BY user_id"}, "events", "event_id % 2 = 0", "event_id % 2 = 1", kinds=("sums",), rounded=("avg_value",), digits=6))
query("ivm_insert_min", "SELECT o_custkey, MIN(o_totalprice) AS low FROM orders GROUP BY o_custkey")(changed({"q": "SELECT o_custkey, MIN(o_totalprice) AS low FROM orders GROUP BY o_custkey"}, "orders", _EVEN, _ODD, kinds=("sums",)))
query("ivm_delete_max", "SELECT o_custkey, MAX(o_totalprice) AS high FROM orders WHERE NOT o_orderkey % 3 = 0 GROUP BY o_custkey")(changed({"q": "SELECT o_custkey, MAX(o_totalprice) AS high FROM orders GROUP BY o_custkey"}, "orders", "true", less="o_orderkey % 3 = 0", kinds=("sums",)))
query("ivm_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")(changed({"q": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"}, "orders", _EVEN, _ODD, kinds=("bag",)))
query("ivm_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")(changed({"q": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"}, "nation", "n_nationkey < 10", "n_nationkey >= 10", kinds=("bag",)))
query("ivm_filter", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")(changed({"q": "SELECT event_id, value FROM events WHERE event_type = 'purchase'"}, "events", "event_id % 2 = 0", "event_id % 2 = 1", kinds=("bag",)))
query("ivm_delete_filter", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND NOT event_id % 5 = 0")(changed({"q": "SELECT event_id, value FROM events WHERE event_type = 'purchase'"}, "events", "true", less="event_id % 5 = 0", kinds=("bag",)))
query("ivm_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")(changed({"q": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"}, "orders", _EVEN, _ODD, kinds=("groups",)))
query("ivm_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")(changed({"q": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority"}, "orders", _EVEN, _ODD, kinds=("sums",)))
query("ivm_global", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE NOT o_orderkey % 3 = 0")(changed({"q": "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders"}, "orders", _EVEN, _ODD, "o_orderkey % 3 = 0", kinds=("full",), rounded=("total",)))
query("ivm_chain", "SELECT COUNT(DISTINCT o_orderpriority) AS kinds, COUNT(*) AS n FROM orders")(changed(CHAIN, "orders", _EVEN, _ODD, read="lvl3"))
query("ivm_diamond", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey")(changed(DIAMOND, "orders", _EVEN, _ODD, read="d"))


query("ivm_delete_sum_long", "SELECT o_custkey, SUM(o_orderkey)::BIGINT AS total, COUNT(*) AS n FROM orders WHERE NOT o_orderkey % 3 = 0 GROUP BY o_custkey")(
    changed({"q": "SELECT o_custkey, SUM(o_orderkey) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey"}, "orders", "true", less="o_orderkey % 3 = 0", kinds=("sums",))
)


#: Queries that follow inserts into and deletes from all tables they read, by how they do; each table has an alias.
_SPENT = "o.o_custkey = c.c_custkey AND o.o_totalprice > 150000"
_BIG = "SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > 250000"
FOLLOWED = {
    "left": ("bag", f"SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON {_SPENT}"),
    "right": ("bag", f"SELECT o.o_orderkey, o.o_orderstatus, c.c_name FROM customer c RIGHT JOIN orders o ON {_SPENT}"),
    "full": ("bag", f"SELECT c.c_custkey, o.o_orderkey FROM customer c FULL OUTER JOIN orders o ON {_SPENT}"),
    "left_group": ("sums", f"SELECT c.c_mktsegment, COUNT(o.o_orderkey) AS orders_n, COUNT(*) AS n FROM customer c LEFT JOIN orders o ON {_SPENT} GROUP BY c.c_mktsegment"),
    "semi": ("bag", f"SELECT c.c_custkey, c.c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE {_SPENT}) AND c.c_acctbal > 0"),
    "anti": ("bag", f"SELECT c.c_custkey, c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE {_SPENT})"),
    "in": ("bag", f"SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE c.c_custkey IN ({_BIG})"),
    "not_in": ("bag", f"SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE c.c_custkey NOT IN ({_BIG})"),
    "distinct": ("sums", "SELECT DISTINCT o.o_custkey, o.o_orderstatus FROM orders o"),
    "union": ("sets", "SELECT c.c_nationkey AS k, c.c_mktsegment AS s FROM customer c UNION SELECT p.s_nationkey, 'supplier' FROM supplier p"),
    "union_all": ("bag", "SELECT c.c_nationkey AS k FROM customer c UNION ALL SELECT p.s_nationkey FROM supplier p"),
    "intersect": ("sets", "SELECT c.c_nationkey AS k FROM customer c INTERSECT SELECT p.s_nationkey FROM supplier p"),
    "intersect_all": ("sets", "SELECT c.c_nationkey AS k FROM customer c INTERSECT ALL SELECT p.s_nationkey FROM supplier p"),
    "except": ("sets", f"SELECT c.c_custkey AS k FROM customer c EXCEPT {_BIG}"),
    "except_all": ("sets", "SELECT c.c_nationkey AS k FROM customer c EXCEPT ALL SELECT p.s_nationkey FROM supplier p"),
    "min_max": ("sums", "SELECT o.o_custkey, MIN(o.o_totalprice) AS low, MAX(o.o_orderdate) AS latest, COUNT(*) AS n FROM orders o GROUP BY o.o_custkey"),
    "count_distincts": ("sums", "SELECT o.o_orderpriority, COUNT(DISTINCT o.o_custkey) AS customers, COUNT(DISTINCT o.o_orderstatus) AS states FROM orders o GROUP BY o.o_orderpriority"),
    "window": ("windows", "SELECT o.o_orderkey, ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rn, COUNT(*) OVER (PARTITION BY o.o_custkey) AS n FROM orders o"),
    "running": ("windows", "SELECT o.o_custkey, o.o_orderkey, COUNT(*) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM orders o"),
    "top": ("top", "SELECT o.o_orderkey, o.o_totalprice FROM orders o ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "rollup": ("sums", "SELECT o.o_orderpriority, o.o_orderstatus, COUNT(*) AS n FROM orders o GROUP BY ROLLUP (o.o_orderpriority, o.o_orderstatus)"),
    "cube": ("sums", "SELECT o.o_orderpriority, o.o_orderstatus, COUNT(*) AS n FROM orders o GROUP BY CUBE (o.o_orderpriority, o.o_orderstatus)"),
    "grouping_sets": ("sums", "SELECT o.o_orderpriority, o.o_orderstatus, COUNT(*) AS n FROM orders o GROUP BY GROUPING SETS ((o.o_orderpriority), (o.o_orderstatus), ())"),
    "derived": ("bag", f"SELECT c.c_name, d.n FROM customer c JOIN (SELECT o.o_custkey AS k, COUNT(*) AS n FROM orders o GROUP BY o.o_custkey) d ON d.k = c.c_custkey WHERE d.n > 8"),
    "cte": ("sums", "WITH per AS (SELECT o.o_custkey AS k, COUNT(*) AS n FROM orders o GROUP BY o.o_custkey), rich AS (SELECT c.c_custkey AS k, c.c_mktsegment AS s FROM customer c WHERE c.c_acctbal > 2000) SELECT rich.s, COUNT(*) AS customers, MAX(per.n) AS most FROM rich LEFT JOIN per ON per.k = rich.k GROUP BY rich.s"),
}
FOLLOWED["closure"] = (
    "bag",
    "WITH RECURSIVE r(root, reached) AS (SELECT c.c_custkey, c.c_custkey FROM customer c WHERE c.c_acctbal > 9900 "
    "UNION SELECT r.root, o.o_orderkey % 1500 + 1 FROM r JOIN orders o ON o.o_custkey = r.reached AND o.o_totalprice > 250000) SELECT root, reached FROM r WHERE reached <> root",
)
#: Sides that are more than plain SELECTs, scalar subqueries, orders by hidden columns, extremes of grouping sets.
FOLLOWED |= {
    "union_three": ("sets", "SELECT c.c_nationkey AS k FROM customer c UNION SELECT p.s_nationkey FROM supplier p UNION SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > 300000"),
    "union_all_groups": ("bag", "SELECT c.c_custkey AS k, 1 AS n FROM customer c UNION ALL SELECT p.s_suppkey, 2 FROM supplier p UNION ALL SELECT o.o_custkey, COUNT(*) FROM orders o GROUP BY o.o_custkey"),
    "except_intersect": ("sets", f"SELECT c.c_custkey AS k FROM customer c EXCEPT {_BIG} INTERSECT SELECT p.s_suppkey FROM supplier p"),
    "scalar": ("bag", "SELECT c.c_custkey, c.c_mktsegment FROM customer c WHERE c.c_custkey > 10 * (SELECT COUNT(*) FROM supplier p ) OR c.c_custkey < (SELECT MAX(p.s_suppkey) FROM supplier p )"),
    "scalar_group": ("sums", "SELECT o.o_orderpriority, COUNT(*) AS n, MAX(o.o_orderkey) AS latest FROM orders o WHERE o.o_custkey <= (SELECT MAX(p.s_suppkey) FROM supplier p ) GROUP BY o.o_orderpriority"),
    "top_hidden": ("top", "SELECT o.o_orderkey, o.o_orderstatus FROM orders o ORDER BY o.o_custkey % 10 DESC, o.o_totalprice, 1 LIMIT 40"),
    "cube_extremes": ("sums", "SELECT o.o_orderpriority, o.o_orderstatus, MIN(o.o_totalprice) AS low, MAX(o.o_orderkey) AS latest FROM orders o GROUP BY CUBE (o.o_orderpriority, o.o_orderstatus)"),
}
#: Key of each table that the queries above read, and which rows go.
_GONE = {"orders": ("o_orderkey", 3), "customer": ("c_custkey", 7), "supplier": ("s_suppkey", 5)}


def followed(text: str, kind: str, insert: bool):
    """The node over half of the rows of each table, then the other half appended table by table; or over all of them, then
    some deleted. Every refresh must be from the change."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in _GONE if f" {t} " in text]
        p = project(spark, sf_dir, {"q": text}, tuple(f"public.{t}" for t in used))
        rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
        half = {t: F.pmod(_GONE[t][0], F.lit(2)) for t in used}
        for t in used:
            p.attach(t, rows[t].where(half[t] == 0) if insert else rows[t])
        p.apply()
        for t in used:
            if insert:
                p.append(t, rows[t].where(half[t] == 1))
            else:
                p.delete(t, rows[t].where(F.pmod(_GONE[t][0], F.lit(_GONE[t][1])) == 0))
            done = p.refresh()
            if set(done.values()) != {kind}:
                raise AssertionError(f"refreshed as {done}")
        return p.read("q")

    return run


def left_over(text: str) -> str:
    """The same over the rows that deletes leave."""
    for t, (key, n) in _GONE.items():
        text = text.replace(f" {t} ", f" (SELECT * FROM {t} WHERE {key} % {n} <> 0) ")
    return text


for _name, (_kind, _text) in FOLLOWED.items():
    query(f"ivm_{_name}_insert", _text)(followed(_text, _kind, True))
    query(f"ivm_{_name}_delete", left_over(_text))(followed(_text, _kind, False))


class Broken(Exception):
    """A write that was made to fail."""


def retried(text: str, kind: str):
    """Refreshes that fail after the first write, the second and so on, and at the commit, until one does not."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, {"q": text}, ("public.orders",))
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
        p.attach("orders", rows.where(_EVEN))
        p.apply()
        p.append("orders", rows.where(_ODD))
        put, failed = p.tables.records.put, 0
        while True:
            writes = []

            def written(path: str) -> None:
                writes.append(path)
                if len(writes) == failed:
                    raise Broken

            def commit(family: str, key, value: dict) -> None:
                if family == "tables" and key == "public.q" and not failed:
                    raise Broken
                put(family, key, value)

            p.tables.written, p.tables.records.put = written, commit
            try:
                done = p.refresh()
                break
            except Broken:
                failed += 1
            finally:
                p.tables.written, p.tables.records.put = (lambda path: None), put
        if failed < 2 or set(done.values()) != {kind}:
            raise AssertionError(f"{failed} failures, then refreshed as {done}")
        return p.read("q")

    return run


query("ivm_retry_sum", _V1 := "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")(retried(_V1, "sums"))
query("ivm_retry_bag", FOLLOWED["left"][1])(retried(FOLLOWED["left"][1], "bag"))
query("ivm_retry_closure", FOLLOWED["closure"][1])(retried(FOLLOWED["closure"][1], "bag"))
query("ivm_retry_sets", FOLLOWED["except"][1])(retried(FOLLOWED["except"][1], "sets"))


@query("ivm_race", "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def ivm_race(spark, sf_dir):
    """Rows are appended at each write of a refresh and of a whole fill; the refresh after that has each of them once."""
    p = project(spark, sf_dir, {"q": "SELECT o_custkey, COUNT(*) AS n, MAX(o_orderkey) AS latest FROM orders GROUP BY o_custkey"}, ("public.orders",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = [f"o_orderkey % 8 = {k}" for k in range(1, 8)]
    p.attach("orders", rows.where("o_orderkey % 8 = 0"))

    def written(path: str) -> None:
        if "/public.q" in path and left:
            p.append("orders", rows.where(left.pop()))

    p.tables.written = written
    p.apply()
    while left:
        p.append("orders", rows.where(left.pop()))
        p.refresh()
    p.tables.written = lambda path: None
    p.refresh()
    return p.read("q")


def in_files(replace: bool):
    """A source in a folder that others write to: new files are added rows, files that went or were replaced count anew."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, {"q": "SELECT event_type, COUNT(*) AS n, MAX(event_id) AS latest FROM events GROUP BY event_type", "r": "SELECT event_id FROM events WHERE event_type = 'click'"}, ("public.events",))
        rows, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{scratch(spark, 'files')}/events"
        rows.where("event_id % 3 = 0").write.parquet(folder)
        p.attach("events", folder)
        p.apply()
        rows.where("event_id % 3 = 1").write.mode("append").parquet(folder)
        first = p.refresh()
        if replace:
            rows.where("event_id % 3 <> 0").write.mode("overwrite").parquet(folder)
        else:
            p.append("events", rows.where("event_id % 3 = 2 AND event_id % 2 = 0"))
            rows.where("event_id % 3 = 2 AND event_id % 2 = 1").write.mode("append").parquet(folder)
        done = p.refresh()
        if list(first.values()) != ["sums", "bag"] or list(done.values()) != (["full", "full"] if replace else ["sums", "bag"]) or set(p.refresh().values()) != {"none"}:
            raise AssertionError(f"refreshed as {first}, {done}")
        return p.read("q").join(p.read("r").agg(F.count("*").alias("clicks")))

    return run


_FILES = "SELECT event_type, COUNT(*) AS n, MAX(event_id) AS latest, (SELECT COUNT(*) FROM events WHERE event_type = 'click'{}) AS clicks FROM events{} GROUP BY event_type"
query("cdc_files", _FILES.format("", ""))(in_files(False))
query("cdc_replaced", _FILES.format(" AND event_id % 3 <> 0", " WHERE event_id % 3 <> 0"))(in_files(True))


@query("ivm_touched_buckets", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def ivm_touched_buckets(spark, sf_dir):
    """One customer's order arrives last: only the bucket of that key is written anew, all others stay as they were."""
    p = project(spark, sf_dir, {"q": _V1}, ("public.orders",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = rows.agg(F.max("o_orderkey")).first()[0]
    p.attach("orders", rows.where(F.col("o_orderkey") != last))
    p.apply()
    place = lambda: [e["folders"][a] if a >= 0 else None for e in [p.tables.entry("public.q")] for a in e["at"]]
    before = place()
    p.append("orders", rows.where(F.col("o_orderkey") == last))
    p.refresh()
    if sum(a != b for a, b in zip(before, place())) != 1:
        raise AssertionError("more than one bucket was written")
    return p.read("q")


@query("ivm_avg_long", "SELECT o_orderpriority, ROUND(AVG((o_orderkey % 1000) * 1e15 + 8e18), -12) AS mean FROM orders GROUP BY o_orderpriority")
def ivm_avg_long(spark, sf_dir):
    """Averages of integers whose sum is beyond 64 bits."""
    p = project(spark, sf_dir, {"q": "SELECT o_orderpriority, AVG(big) AS mean FROM orders GROUP BY o_orderpriority"}, ("public.orders",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 1000 * 10**15 + 8 * 10**18).alias("big"))
    p.attach("orders", rows.where(_EVEN))
    p.apply()
    p.append("orders", rows.where(_ODD))
    if set(p.refresh().values()) != {"sums"}:
        raise AssertionError("not from the change")
    return p.read("q").withColumn("mean", F.round("mean", -12))


_YEARS = "SELECT EXTRACT(YEAR FROM o.o_orderdate) AS y, COUNT(*) AS n, MAX(SUBSTRING(o.o_orderpriority FROM 1 FOR 3)) AS p FROM orders o GROUP BY EXTRACT(YEAR FROM o.o_orderdate)"
query("ivm_extract", _YEARS)(followed(_YEARS, "sums", True))


def swallowed(value: str):
    """Doubles of which some would swallow the others of a sum; those rows go again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, {"q": "SELECT o_custkey, SUM(v) AS total, AVG(v) AS mean, COUNT(*) AS n FROM orders GROUP BY o_custkey"}, ("public.orders",))
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
        v = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float(value))).otherwise(F.floor("o_totalprice").cast("double"))
        rows = rows.select("o_orderkey", "o_custkey", v.alias("v"))
        p.attach("orders", rows)
        p.apply()
        p.delete("orders", rows.where("o_orderkey % 7 = 0"))
        p.refresh()
        return p.read("q").withColumn("mean", F.round("mean", 6))

    return run


_REST = "SELECT o_custkey, SUM(FLOOR(o_totalprice)) AS total, ROUND(AVG(FLOOR(o_totalprice)), 6) AS mean, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey"
query("ivm_delete_sum_float", _REST)(swallowed("1e16"))
query("ivm_delete_nan", _REST)(swallowed("nan"))


@query("ivm_literal_clause", "SELECT o_custkey, MAX(o_totalprice) AS top, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def ivm_literal_clause(spark, sf_dir):
    """A literal that looks like a clause; rows go and come back."""
    p = project(spark, sf_dir, {"q": "SELECT o_custkey, MAX(o_totalprice) AS top, COUNT(*) AS n FROM orders WHERE o_orderpriority <> 'x GROUP BY y' GROUP BY o_custkey"}, ("public.orders",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p.attach("orders", rows)
    p.apply()
    some = rows.where("o_orderkey % 3 = 0")
    p.delete("orders", some)
    p.refresh()
    p.append("orders", some)
    p.refresh()
    return p.read("q")


@query("ivm_immediate", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def ivm_immediate(spark, sf_dir):
    """The append alone brings an IMMEDIATE node up to date."""
    p = project(spark, sf_dir, {"q": "-- @m:refresh_mode = IMMEDIATE\nSELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey"}, ("public.orders",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    p.attach("orders", rows.where(_EVEN))
    p.apply()
    p.append("orders", rows.where(_ODD))
    return p.read("q")


# Changes of definition: apply one version, then the next


def evolved(before: str, after: str, expect: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, {"q": before})
        p.apply()
        p.define({"streams/q.sql": after})
        for d in p._desired.nodes[0].depends_on:
            if not p.tables.version(d):
                p.attach(str(d), f"{sf_dir}/{d.name}.parquet")
        plan = p.plan()
        if [c.cls for c in plan.summary.changes] != [expect]:
            raise AssertionError(f"classified as {[c.cls for c in plan.summary.changes]}")
        p.apply(plan)
        if not p.plan().empty:
            raise AssertionError("a second plan is not empty")
        return p.read("q")

    return run


for _key, _before, _after, _class in (
    ("inplace_add_sum", _V1, "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey", "in-place"),
    ("inplace_drop_tail", "SELECT o_custkey, COUNT(*) AS n, MIN(o_totalprice) AS low FROM orders GROUP BY o_custkey", _V1, "in-place"),
    ("rebuild_group_by", _V1, "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "rebuild"),
    ("rebuild_where", _V1, "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey", "rebuild"),
    ("rebuild_join", _V1, "SELECT c.c_custkey, c.c_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name", "rebuild"),
    ("rebuild_rename", _V1, "SELECT o_custkey, COUNT(*) AS orders_n FROM orders GROUP BY o_custkey", "rebuild"),
    ("full_to_diff", "-- @m:refresh_mode = FULL\n" + _V1, _V1, "rebuild"),
    ("free_schedule", _V1, '-- @m:schedule = "1h"\n' + _V1, "free"),
):
    query(_key, _after.split("\n")[-1])(evolved(_before, _after, _class))


@query("rollback_prior", _V1)
def rollback_prior(spark, sf_dir):
    p = project(spark, sf_dir, {"q": _V1})
    p.apply()
    p.define({"streams/q.sql": "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority"})
    p.apply()
    p.rollback()
    return p.read("q")


_VIEW = {
    "streams/q.sql": "SELECT o_custkey AS customer_id, COUNT(*) AS n FROM orders GROUP BY o_custkey",
    "consumers/v.sql": "-- @m:kind = consumer\n-- @m:source = q\n-- @m:expose_as = api.orders\nSELECT customer_id, n FROM q WHERE n > 2",
}


@query("consumer_view", "SELECT o_custkey AS customer_id, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 2")
def consumer_view(spark, sf_dir):
    p = Project(spark, "driver").init()
    p.define(_VIEW)
    p.attach("orders", f"{sf_dir}/orders.parquet")
    p.apply()
    return p.read("api.orders")


@query("consumer_swap_bluegreen", "SELECT o_custkey AS customer_id, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING COUNT(*) > 2")
def consumer_swap_bluegreen(spark, sf_dir):
    """The changed node is built beside the old one; the view moves over with it."""
    p = Project(spark, "driver").init()
    p.define(_VIEW)
    p.attach("orders", f"{sf_dir}/orders.parquet")
    p.apply()
    p.define(_VIEW | {"streams/q.sql": "SELECT o_custkey AS customer_id, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"})
    p.apply(strategy="blue-green")
    return p.read("api.orders")


@query("source_cascade", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
def source_cascade(spark, sf_dir):
    """An owned source gains a column; the node that groups by it follows."""
    ddl = "-- @m:kind = source\n-- @m:owned = true\nCREATE TABLE raw_orders (o_orderkey bigint, o_custkey bigint{})"
    p = Project(spark, "driver").init()
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    p.attach("raw_orders", rows.select("o_orderkey", "o_custkey"))
    p.define({"sources/raw_orders.sql": ddl.format(""), "streams/q.sql": "SELECT o_custkey, COUNT(*) AS n FROM raw_orders GROUP BY o_custkey"})
    p.apply()
    p.define({"sources/raw_orders.sql": ddl.format(", o_orderpriority text"), "streams/q.sql": "SELECT o_orderpriority, COUNT(*) AS n FROM raw_orders GROUP BY o_orderpriority"})
    p.apply()
    p.attach("raw_orders", rows)
    p.refresh()
    return p.read("q")


@query("preview_sample", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) < '33333333' GROUP BY o_custkey")
def preview_sample(spark, sf_dir):
    """A node over a fifth of its source, by the hash of a key."""
    p = project(spark, sf_dir, {"q": _V1})
    p.apply()
    return p.preview("feature/x", 0.2, keys={"orders": "o_orderkey"}).read("q")


@query("stream_events", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_events(spark, sf_dir):
    """Events as a file stream into a source, its node refreshed batch by batch."""
    from .streaming.stream import follow

    p = project(spark, sf_dir, {"q": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type"}, ("public.events",))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = scratch(spark, "stream")
    p.attach("events", rows.limit(0))
    p.apply()
    for part in range(2):
        rows.where(F.pmod("event_id", F.lit(2)) == part).write.parquet(f"{folder}/in/part={part}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*")
        follow(p, stream, "events", f"{folder}/checkpoint", available_now=True).awaitTermination()
    return p.read("q")


@query("stream_two", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def stream_two(spark, sf_dir):
    """Two streams with checkpoints of their own into one source; every batch counts once."""
    from .streaming.stream import follow

    p = project(spark, sf_dir, {"q": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type"}, ("public.events",))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = scratch(spark, "streams")
    p.attach("events", rows.limit(0))
    p.apply()
    for part in range(2):
        rows.where(F.pmod("event_id", F.lit(2)) == part).write.parquet(f"{folder}/{part}")
        for _ in range(2):  # started again, a stream that is through adds nothing
            follow(p, spark.readStream.schema(rows.schema).parquet(f"{folder}/{part}"), "events", f"{folder}/checkpoint-{part}", available_now=True).awaitTermination()
    return p.read("q")


# Metadata: what the planner says, as rows


def _values(columns: str, rows: list[tuple], types: tuple[str, ...]) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names = columns.split(", ")
    lines = ", ".join(f"({', '.join(map(show, r))})" for r in rows)
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return f"SELECT {cast} FROM (VALUES {lines}) v({columns})"


def _frame(spark, columns: str, rows: list[tuple], types: tuple[str, ...]) -> DataFrame:
    names = {"VARCHAR": "string", "BIGINT": "long", "INTEGER": "int", "BOOLEAN": "boolean"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {names[t]}" for c, t in zip(columns.split(", "), types)))


_ABC = {"b": "SELECT * FROM a", "a": "SELECT 1 AS x", "c": "SELECT * FROM a JOIN b ON a.x = b.x", "d": "SELECT * FROM b UNION ALL SELECT * FROM c", "e": "SELECT 2 AS y"}


def _abc(spark) -> State:
    return dag.build(spark, [files.parse(f"streams/{n}.sql", t) for n, t in _ABC.items()])


@query("dag_levels", _values("name, depth", [("public.a", 0), ("public.b", 1), ("public.c", 2), ("public.d", 3), ("public.e", 0)], ("VARCHAR", "INTEGER")))
def dag_levels(spark, sf_dir):
    return dag.levels(spark, _abc(spark))


@query("topological_order", _values("pos, name", [(0, "public.a"), (1, "public.e"), (2, "public.b"), (3, "public.c"), (4, "public.d")], ("INTEGER", "VARCHAR")))
def topological_order(spark, sf_dir):
    return _frame(spark, "pos, name", [(i, str(n)) for i, n in enumerate(dag.topological(_abc(spark)))], ("INTEGER", "VARCHAR"))


@query("subgraph", _values("name", [("public.a",), ("public.b",), ("public.c",), ("public.d",)], ("VARCHAR",)))
def subgraph(spark, sf_dir):
    return _frame(spark, "name", [(str(n),) for n in dag.subgraph(_abc(spark), Name.parse("b"))], ("VARCHAR",))


_BASE = "SELECT k, SUM(v) AS s FROM t GROUP BY k"
_CASES = [
    ("same query, other case", _BASE, "select k, sum(v) as s from t group by k", "free"),
    ("added column", _BASE, "SELECT k, SUM(v) AS s, COUNT(*) AS n FROM t GROUP BY k", "in-place"),
    ("removed column", "SELECT k, SUM(v) AS s, COUNT(*) AS n FROM t GROUP BY k", _BASE, "in-place"),
    ("renamed column", _BASE, "SELECT k, SUM(v) AS total FROM t GROUP BY k", "rebuild"),
    ("other keys", _BASE, "SELECT j, SUM(v) AS s FROM t GROUP BY j", "rebuild"),
    ("added join", _BASE, "SELECT k, SUM(v) AS s FROM t JOIN u USING (k) GROUP BY k", "rebuild"),
    ("added filter", _BASE, "SELECT k, SUM(v) AS s FROM t WHERE v > 0 GROUP BY k", "rebuild"),
    ("other literal", "SELECT k FROM t WHERE c = 'Click'", "SELECT k FROM t WHERE c = 'click'", "rebuild"),
    ("added having", _BASE, _BASE + " HAVING SUM(v) > 1", "rebuild"),
    ("added distinct", "SELECT k FROM t", "SELECT DISTINCT k, v FROM t", "rebuild"),
    ("changed with", "WITH c AS (SELECT k FROM t) SELECT k FROM c", "WITH c AS (SELECT k FROM u) SELECT k, 1 AS x FROM c", "rebuild"),
    ("set operation", "SELECT k FROM t UNION ALL SELECT k FROM u", "SELECT k FROM t UNION SELECT k FROM u", "rebuild"),
    ("not parsable", _BASE, "SELEC k FROM t", "rebuild"),
    ("inserted in the middle", "SELECT k, SUM(v) AS s FROM t GROUP BY k", "SELECT k, COUNT(*) AS n, SUM(v) AS s FROM t GROUP BY k", "rebuild"),
]


def _class_of(spark, old: str, new: str) -> str:
    from .plans.diff import compare

    a, b = (Node(Name.parse("q"), q) for q in (old, new))
    c = compare(a, b)
    return str(classify.classify(spark, c))


@query("classify_matrix", _values("case_name, class", [(c[0], c[3]) for c in _CASES], ("VARCHAR", "VARCHAR")))
def classify_matrix(spark, sf_dir):
    return _frame(spark, "case_name, class", [(n, _class_of(spark, a, b)) for n, a, b, _ in _CASES], ("VARCHAR", "VARCHAR"))


_MODES = [("FULL", "DIFFERENTIAL", "rebuild"), ("DIFFERENTIAL", "FULL", "free"), ("IMMEDIATE", "DIFFERENTIAL", "free"), ("DIFFERENTIAL", "IMMEDIATE", "free")]


@query("classify_modes", _values("old, new, class", _MODES, ("VARCHAR",) * 3))
def classify_modes(spark, sf_dir):
    from .model import Mode

    got = [(a, b, str(classify.classify(spark, NodeChange(Name.parse("q"), "mode", Node(Name.parse("q"), _BASE, Mode(a)), Node(Name.parse("q"), _BASE, Mode(b)), ["mode"])))) for a, b, _ in _MODES]
    return _frame(spark, "old, new, class", got, ("VARCHAR",) * 3)


_STEPS = ["LockDag", "ValidateQuery", "CreateStreamTable", "Backfill", "ValidateQuery", "CreateStreamTable", "Backfill", "ManageConsumerView", "RecordSnapshot", "UnlockDag"]


@query("plan_steps", _values("idx, step_type", list(enumerate(_STEPS)), ("INTEGER", "VARCHAR")))
def plan_steps(spark, sf_dir):
    files_ = {"streams/a.sql": "SELECT 1 AS x", "streams/b.sql": "SELECT x FROM a", "consumers/v.sql": "-- @m:kind = consumer\n-- @m:source = b"}
    plan = Project(spark, "driver").init().define(files_).plan()
    return planner.step_rows(spark, plan).select("idx", "step_type")


_DIFFS = [("public", "a", "unchanged"), ("public", "b", "query"), ("public", "c", "schedule"), ("public", "d", "metadata"), ("public", "e", "create"), ("public", "f", "drop")]


@query("diff_rows", _values("schema, name, kind", _DIFFS, ("VARCHAR",) * 3))
def diff_rows(spark, sf_dir):
    from .model import Mode
    from .plans.diff import diff_rows as rows

    node = lambda n, q="SELECT 1 AS x", **k: Node(Name.parse(n), q, **k)
    live = State([node("a"), node("b"), node("c"), node("d"), node("f")])
    want = State([node("a", "select  1 as x;"), node("b", "SELECT 2 AS x"), node("c", schedule="5m"), node("d", schedule="5m", mode=Mode.FULL), node("e")])
    return rows(spark, want, live)


_COSTS = [(0, "< 1s"), (1000, "< 1s"), (1_000_000, "~3s"), (100_000_000, "~6m"), (10_000_000_000, "~10h")]


@query("cost_text", _values("estimate, duration", _COSTS, ("BIGINT", "VARCHAR")))
def cost_text(spark, sf_dir):
    return _frame(spark, "estimate, duration", [(r, cost.duration_text(r)) for r, _ in _COSTS], ("BIGINT", "VARCHAR"))


_WINDOWS = [("02:00-04:00", "03:00", True), ("02:00-04:00", "04:00", False), ("22:00-02:00 UTC", "23:30", True), ("22:00-02:00", "12:00", False), ("02:00-04:00 +02:00", "01:00", True), ("nonsense", "12:00", True)]


@query("window_check", _values("span, moment, allowed", _WINDOWS, ("VARCHAR", "VARCHAR", "BOOLEAN")))
def window_check(spark, sf_dir):
    got = [(w, t, in_window(w, datetime.strptime(f"2024-01-01 {t}", "%Y-%m-%d %H:%M"))) for w, t, _ in _WINDOWS]
    return _frame(spark, "span, moment, allowed", got, ("VARCHAR", "VARCHAR", "BOOLEAN"))


_SCHEDULES = [("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400), ("45", 45), ("calculated", -1)]


@query("schedule_parse", _values("schedule, secs", _SCHEDULES, ("VARCHAR", "INTEGER")))
def schedule_parse(spark, sf_dir):
    return _frame(spark, "schedule, secs", [(s, seconds(s) or -1) for s, _ in _SCHEDULES], ("VARCHAR", "INTEGER"))


_REFS = [("SELECT * FROM a JOIN s.b ON a.x = b.x", "public.a s.b"), ("WITH c AS (SELECT * FROM t) SELECT * FROM c WHERE x IN (SELECT y FROM u)", "public.t public.u"), ("SELECT 1 AS x", ""), ("SELECT * FROM (SELECT * FROM x1 UNION SELECT * FROM x2) d", "public.x1 public.x2")]


@query("query_references", _values("sql_text, tables", _REFS, ("VARCHAR", "VARCHAR")))
def query_references(spark, sf_dir):
    return _frame(spark, "sql_text, tables", [(q, " ".join(sorted(map(str, references(spark, q))))) for q, _ in _REFS], ("VARCHAR", "VARCHAR"))


_CHECKS = [("SELECT k FROM t", "ok", "ok"), ("SELECT DISTINCT k FROM t", "IvmUnsupportable", "ok"), ("SELECT k FROM t UNION SELECT k FROM u", "IvmUnsupportable", "ok"), ("SELECT upper(CAST(uuid() AS STRING)) AS u FROM t", "IvmUnsupportable", "ok"), ("DROP TABLE t", "IvmUnsupportable", "UntrustedSql"), ("SELECT 1; DROP TABLE t", "SqlParseError", "UntrustedSql"), ("SELEC k FROM t", "SqlParseError", "SqlParseError")]


@query("query_checks", _values("sql_text, maintainable, view_body", _CHECKS, ("VARCHAR",) * 3))
def query_checks(spark, sf_dir):
    def verdict(check, q):
        try:
            check(spark, q, "q")
            return "ok"
        except Exception as e:
            return type(e).__name__

    return _frame(spark, "sql_text, maintainable, view_body", [(q, verdict(check_ivm, q), verdict(check_consumer, q)) for q, _, _ in _CHECKS], ("VARCHAR",) * 3)


_LINT = {
    "streams/fast.sql": '-- @m:schedule = "1s"\nSELECT k FROM t',
    "streams/all_rows.sql": "-- @m:refresh_mode = FULL\nSELECT k FROM t",
    "streams/uniq.sql": "SELECT DISTINCT k FROM t WHERE k > 0",
    "consumers/lost.sql": "-- @m:kind = consumer\n-- @m:source = nowhere\nSELECT * FROM nowhere",
    "streams/odd.sql": "-- @m:future = 1\nSELECT k FROM t",
}
_LINTED = [("all_rows", "L:full-refresh-no-filter"), ("all_rows", "L:rebuild-may-affect-rls"), ("fast", "L:schedule-too-aggressive"), ("lost", "L:consumer-source-not-found"), ("uniq", "L:differential-ivm-unsupportable"), ("odd", "W001"), ("uniq", "E102")]


@query("lint_rules", _values("file, code", _LINTED, ("VARCHAR", "VARCHAR")))
def lint_rules(spark, sf_dir):
    p = Project(spark, "driver").define(_LINT)
    return _frame(spark, "file, code", [(files.ProjectFile(d.file).stem, d.code) for d in [*p.lint(), *p.validate()]], ("VARCHAR", "VARCHAR"))


_FRONT = '-- @m:kind = "stream"\n-- a comment\n-- @m:schedule = "5m"\n-- @m:depends_on = ["raw.x"]\n-- @m:cdc_mode = "row"\n-- @m:later = 7\n\nselect a, \'from\' as b from raw.x  where a>1;\n'
_FRONTED = [("cdc_mode", "trigger"), ("depends_on", "raw.x"), ("later", "7"), ("schedule", "5m"), ("sql", "SELECT a, 'from' AS b FROM raw.x  WHERE a>1")]


@query("front_matter", _values("key, value", _FRONTED, ("VARCHAR", "VARCHAR")))
def front_matter(spark, sf_dir):
    f = files.parse("streams/x.sql", _FRONT)
    rows = [(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in (f.directives | f.unknown).items()]
    return _frame(spark, "key, value", [*rows, ("sql", fmt.keywords(f.sql))], ("VARCHAR", "VARCHAR"))


@query("audit_history", _values("migration_id, status, to_version, step_count, failed_steps, last_error", [(1, "committed", 1, 6, 0, None), (2, "committed", 2, 4, 0, None)], ("BIGINT", "VARCHAR", "BIGINT", "BIGINT", "BIGINT", "VARCHAR")))
def audit_history(spark, sf_dir):
    p = Project(spark, "driver").init().define({"streams/a.sql": "SELECT 1 AS x"})
    p.apply()
    p.define({"streams/a.sql": '-- @m:schedule = "5m"\nSELECT 1 AS x'})
    p.apply()
    return p.audit().select("migration_id", "status", "to_version", "step_count", "failed_steps", "last_error")


@query("drift_counts", _values("moment, nodes, drift", [("applied", 1, 0), ("changed", 1, 2)], ("VARCHAR", "INTEGER", "INTEGER")))
def drift_counts(spark, sf_dir):
    p = Project(spark, "driver").init().define({"streams/a.sql": "SELECT 1 AS x"})
    p.apply()
    rows = [("applied", p.status()["nodes"], p.status()["drift"])]
    p.define({"streams/a.sql": '-- @m:schedule = "5m"\nSELECT 1 AS x', "streams/b.sql": "SELECT x FROM a"})
    return _frame(spark, "moment, nodes, drift", [*rows, ("changed", p.status()["nodes"], p.status()["drift"])], ("VARCHAR", "INTEGER", "INTEGER"))


# Flagship: orders to totals to tiers behind a view

TIERS = {
    "streams/order_totals.sql": '-- @m:schedule = "1m"\nSELECT o_custkey AS customer_id, SUM(o_totalprice) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey',
    "streams/customer_tiers.sql": "SELECT customer_id, CASE WHEN total > 2000000 THEN 'gold' WHEN total > 1000000 THEN 'silver' ELSE 'base' END AS tier, n FROM order_totals",
    "consumers/tiers.sql": "-- @m:kind = consumer\n-- @m:source = customer_tiers\n-- @m:expose_as = api.tiers\nSELECT customer_id, tier, n FROM customer_tiers",
}


@query("customer_tiers", "SELECT o_custkey AS customer_id, CASE WHEN SUM(o_totalprice) > 2000000 THEN 'gold' WHEN SUM(o_totalprice) > 1000000 THEN 'silver' ELSE 'base' END AS tier, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def customer_tiers(spark, sf_dir):
    p = Project(spark, "driver").init().define(TIERS)
    p.attach("orders", f"{sf_dir}/orders.parquet")
    p.apply()
    return p.read("api.tiers")

import json
import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace import errors
from millrace.functions import fmt
from millrace.model import Class, Mode, Name, Node, State
from millrace.operators.executor import ddl_columns
from millrace.operators.project import Project
from millrace.operators.refresh import Refresher, rule_for
from millrace.plans import dag, planner, render
from millrace.plans.diff import diff
from millrace.plans.shape import normalised, relocate
from millrace.sources import config, dbt
from millrace.sources import project as files

TOTALS = "SELECT k, SUM(v) AS s, COUNT(*) AS n FROM raw.t GROUP BY k"


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def table(spark, data):
    return spark.createDataFrame(data, "k string, v long, j long")


def project(spark, nodes, data=(("a", 1, 1), ("b", 2, 2), ("a", None, 1))):
    p = Project(spark, "proj").init()
    p.attach("raw.t", table(spark, list(data)))
    p.define({f"streams/{n}.sql": q for n, q in nodes.items()})
    return p


def test_names_and_modes():
    assert Name.parse("a.b.c") == Name("a", "b.c") and Name.parse("x") == Name("public", "x")
    assert Mode.parse("full") == Mode.FULL
    with pytest.raises(errors.ConfigError):
        Mode.parse("weekly")
    assert errors.CycleError.code == 1201 and errors.MillraceError.code == 9999


def test_front_matter_and_format(monkeypatch):
    f = files.parse("streams/x.sql", '\n-- @m:schedule = "{{ var.pace }}"\n-- note\n-- @m:odd = 1\nselect a from t where b = \'from\';\n', {"pace": "5m"})
    assert f.get("schedule") == "5m" and f.unknown == {"odd": "1"} and f.sql == "select a from t where b = 'from'"
    assert fmt.render(f) == "-- @millrace:schedule = \"5m\"\n-- @millrace:odd = 1\n\nSELECT a FROM t WHERE b = 'from'\n"
    again = files.parse("streams/x.sql", fmt.render(f))
    assert fmt.render(again) == fmt.render(f)
    with pytest.raises(errors.MissingVariable):
        files.parse("x.sql", '-- @m:schedule = "{{ var.none }}"\nselect 1')
    monkeypatch.setenv("MILLRACE_VAR_pace", "9s")
    assert files.parse("x.sql", '-- @m:schedule = "{{ var.pace }}"\nselect 1', {"pace": "5m"}).get("schedule") == "9s"
    for bad in ('kind = "table"', "owned = maybe", "depends_on = [1]", 'cdc_mode = "x"'):
        with pytest.raises(errors.ParseError):
            files.parse("x.sql", f"-- @m:{bad}\nselect 1")


def test_config(monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    c = config.Config.parse('[project]\nname="p"\n[targets.prod]\nwarehouse="${PLACE}/w"\nvars={x=1}\n[apply]\nmaintenance_window="02:00-04:00"\n[apply.hooks]\npre="select 1"\n')
    assert c.target("prod").warehouse == "/data/w" and c.target("prod").vars == {"x": "1"} and c.apply.pre_hooks == ["select 1"]
    with pytest.raises(errors.ConfigError, match="prod"):
        c.target("dev")
    with pytest.raises(errors.TomlError):
        config.Config.parse("[")
    for name in ("1x", "pg_x", "public", "a-b"):
        with pytest.raises(errors.ConfigError):
            config.catalog_name(name)
    for dsn in ("postgres://u:secret@h/db", "host=h password=x"):
        with pytest.raises(errors.PlaintextPassword):
            config.check_password(dsn)
    config.check_password("postgres://u@h/db")
    assert not config.in_window("22:00-02:00", datetime(2024, 1, 1, 12)) and config.in_window(None, datetime(2024, 1, 1))


def test_shapes(spark):
    assert normalised("SELECT  A FROM t -- x\n WHERE b='Click';") == "select a from t where b='Click'"
    assert relocate("SELECT t.k FROM t, s.u x JOIN (SELECT * FROM t) y ON x.a = y.a", lambda n, k: f"mr_{n.name}{k}") == "SELECT t.k FROM mr_t0 AS t, mr_u0 x JOIN (SELECT * FROM mr_t1 AS t) y ON x.a = y.a"
    assert relocate("SELECT 'from t' AS c FROM t WHERE x IN (SELECT y FROM u)", lambda n, k: f"mr_{n.name}") == "SELECT 'from t' AS c FROM mr_t AS t WHERE x IN (SELECT y FROM mr_u AS u)"
    assert [rule_for(spark, q).kind for q in (TOTALS, "SELECT k FROM t", "SELECT k, COUNT(DISTINCT v) AS n FROM t GROUP BY k", "SELECT DISTINCT k FROM t", "SELECT a.k FROM t a LEFT JOIN t b ON a.k=b.k", "SELECT k, CASE WHEN SUM(v)>1 THEN 1 END AS x FROM t GROUP BY 1")] == ["sums", "bag", "sums", "sums", "bag", "groups"]


def test_graph(spark):
    state = dag.build(spark, [files.parse(f"streams/{n}.sql", q) for n, q in {"d": "select * from b join c using(x)", "b": "select x from a", "c": "select x from a", "a": "select 1 as x"}.items()])
    assert [n.name for n in dag.topological(state)] == ["a", "b", "c", "d"]
    assert dag.promote_diamonds(state, {Name.parse("d"): Class.FREE, Name.parse("b"): Class.REBUILD, Name.parse("c"): Class.FREE}) == {Name.parse(n): Class.REBUILD for n in "dbc"}
    assert dag.subgraph(state, Name.parse("zz")) == set()
    loop = State([Node(Name.parse("a"), "", depends_on=[Name.parse("b")]), Node(Name.parse("b"), "", depends_on=[Name.parse("a")])])
    with pytest.raises(errors.CycleError):
        dag.topological(loop)


def test_lifecycle(spark, tmp_path):
    p = project(spark, {"totals": TOTALS, "top": "SELECT k, s FROM totals WHERE s > 1"})
    plan = p.plan()
    assert planner.restore(planner.save(plan), p._desired).to_json() == plan.to_json()
    assert "rebuild: filled anew" in render.text(plan, p.cost(plan)) and "- `public.totals`" in render.markdown(plan) and "steps:" in render.yaml(plan) and json.loads(render.as_json(plan))
    assert p.apply(dry_run=True)["status"] == "dry-run" and p.catalog.latest("proj") is None
    p.apply(plan)
    assert p.plan().empty and p.apply()["status"] == "empty"
    assert rows(p.read("top")) == [("b", 2)]
    p.define({"streams/totals.sql": TOTALS.replace("COUNT(*) AS n", "COUNT(*) AS n, MAX(v) AS top_v"), "streams/top.sql": "SELECT k, s FROM totals WHERE s > 1"})
    with pytest.raises(errors.StalePlan):
        planner.restore(planner.save(plan), p._desired)
    assert [c.cls for c in p.plan().summary.changes] == ["in-place"]
    p.apply()
    assert rows(p.read("totals")) == [("a", 1, 2, 1), ("b", 2, 1, 2)]
    p.append("raw.t", table(spark, [("c", 9, 1)]))
    assert p.refresh() == {"public.totals": "sums", "public.top": "bag"}
    assert rows(p.read("top")) == [("b", 2), ("c", 9)]
    assert p.refresh() == {"public.totals": "none", "public.top": "none"}
    assert p.rollback(1)["version"] == 3 and p.read("totals").columns == ["k", "s", "n"]
    assert p.status()["version"] == 3 and p.audit().count() == 3
    other = Project(spark, "proj").init()
    other.attach("raw.t", table(spark, [("z", 5, 1)]))
    p.promote(other)
    assert rows(other.read("totals")) == [("z", 5, 1)]
    assert p.export(tmp_path) == 2 and len(files.load(tmp_path)) == 2
    again = Project(spark, "proj", p.root).load(tmp_path)
    assert [c.kind for c in again.diff().changes] == []
    assert p.preview("b/1", 1.0, "top").read("top").count() == 2 and p.previews() == ["b_1"] and p.drop_preview("b/1")
    assert p.destroy(dry_run=True) == ["public.top", "public.totals"] == p.destroy() and p.live().nodes == []


def test_gates(spark):
    p = project(spark, {"q": TOTALS})
    p.apply()
    p.define({"streams/q.sql": "SELECT j, SUM(v) AS s FROM raw.t GROUP BY j"})
    with pytest.raises(errors.FullRefreshNotAllowed):
        p.apply(allow_rebuild=False)
    p.config.apply.maintenance_window = "02:00-02:01"
    p.clock = lambda: 12 * 3600
    with pytest.raises(errors.MaintenanceWindow):
        p.apply()
    p.config.apply.maintenance_window = None
    p.define({"streams/q.sql": "-- @m:refresh_mode = IMMEDIATE\n" + TOTALS})
    p.apply()
    p.define({"streams/q.sql": "-- @m:refresh_mode = IMMEDIATE\nSELECT j FROM raw.t"})
    with pytest.raises(errors.ImmediateDowngradeRejected):
        p.plan(no_immediate_downgrade=True)
    assert {"PauseImmediate", "ResumeImmediate"} <= {s.type for s in p.plan().steps}


def test_failure_at_every_step_resumes(spark):
    nodes = {"q": "SELECT k, COUNT(*) AS n FROM raw.t GROUP BY k", "r": "SELECT k FROM q"}
    changed = {"streams/q.sql": "SELECT j, COUNT(*) AS n FROM raw.t GROUP BY j", "streams/r.sql": "SELECT j FROM q"}
    p = project(spark, nodes)
    p.apply()
    n = len(p.define(changed).plan().steps)
    for i in random.Random(3).sample(range(n), 5):
        p = project(spark, nodes)
        p.apply()
        p.define(changed)
        with pytest.raises(errors.InvariantViolation):
            p.apply(fail_at=i)
        assert p.catalog.records.get("locks", "proj") is None
        p.apply(resume=True)
        assert p.plan().empty and rows(p.read("q")) == [(1, 2), (2, 1)] and rows(p.read("r")) == [(1,), (2,)]
        assert not any(p.catalog.node(x)["paused"] for x in ("public.q", "public.r"))


def test_lock(spark):
    p = project(spark, {"q": TOTALS})
    p.catalog.lock("proj", "someone", 60, [])
    with pytest.raises(errors.LockContention, match="someone"):
        p.apply()
    with pytest.raises(errors.MillraceError):
        p.unlock()
    assert p.unlock(force=True) and not p.unlock()
    p.catalog.lock("proj", "someone", -1, [])
    p.apply()


def test_ownership_and_isolation(spark):
    p = project(spark, {"q": TOTALS})
    p.apply()
    other = Project(spark, "other", p.root).init().define({"streams/x.sql": "SELECT k FROM q"})
    other.apply()
    assert [n.name.name for n in p.live().nodes] == ["q"] and other.catalog.latest("other") == 1
    with pytest.raises(errors.OwnershipRequired):
        p.destroy()
    thief = Project(spark, "thief", p.root).define({"streams/q.sql": "SELECT 1 AS k"})
    with pytest.raises(errors.CatalogError):
        thief.apply()


def test_view_bodies_are_checked(spark):
    p = project(spark, {"q": TOTALS})
    p.define({"streams/q.sql": TOTALS, "consumers/v.sql": "-- @m:kind = consumer\n-- @m:source = q\nDROP TABLE q"})
    with pytest.raises(errors.UntrustedSql):
        p.apply()


def test_swap_is_all_or_nothing(spark):
    view = "-- @m:kind = consumer\n-- @m:source = q\n-- @m:expose_as = api.v\nSELECT k, n FROM q"
    p = project(spark, {})
    p.define({"streams/q.sql": TOTALS, "consumers/v.sql": view})
    p.apply()
    p.define({"streams/q.sql": TOTALS + " HAVING COUNT(*) > 1", "consumers/v.sql": view, "consumers/w.sql": view.replace("api.v", "api.w").replace("k, n", "missing")})
    with pytest.raises(Exception):
        p.apply(strategy="blue-green")
    assert rows(p.read("api.v")) == [("a", 2), ("b", 1)]
    p.define({"streams/q.sql": TOTALS + " HAVING COUNT(*) > 1", "consumers/v.sql": view})
    p.apply(strategy="blue-green")
    assert rows(p.read("api.v")) == [("a", 2)] and p.plan().empty


def test_schedule(spark):
    p = project(spark, {"slow": '-- @m:schedule = "1h"\n' + TOTALS, "fast": '-- @m:schedule = "1s"\nSELECT k FROM raw.t'})
    p.apply()
    p.append("raw.t", table(spark, [("x", 1, 1)]))
    now = p.clock()
    assert set(p.refresh_due(now + 4000)) == {"public.slow", "public.fast"}
    p.append("raw.t", table(spark, [("y", 1, 1)]))
    assert set(p.refresh_due(p.clock() + 100)) == {"public.fast"}


def test_dbt(tmp_path):
    (tmp_path / "target/compiled").mkdir(parents=True)
    (tmp_path / "target/compiled/m.sql").write_text("select k from raw.t;")
    node = {"resource_type": "model", "name": "m", "schema": "an", "config": {"materialized": "stream_table", "schedule": "5m"}, "depends_on": {"nodes": ["source.t"]}}
    manifest = {"nodes": {"x": node, "y": node | {"config": {"materialized": "view"}}, "z": node | {"name": "lost"}}, "sources": {"source.t": {"schema": "raw", "name": "t"}}}
    (tmp_path / "target/manifest.json").write_text(json.dumps(manifest))
    out = dbt.ingest(tmp_path / "target", tmp_path / "out")
    assert len(out.written) == 2 and out.missing == ["lost"] and not dbt.ingest(tmp_path / "target", tmp_path / "out").changed
    assert {f.get("schema") for f in files.load(tmp_path / "out")} == {"an", "raw"}


def test_ddl():
    assert ddl_columns("CREATE TABLE raw.t (id bigint PRIMARY KEY, amount numeric(12,2) NOT NULL, tags text[], PRIMARY KEY (id))") == [("id", "bigint"), ("amount", "decimal(12,2)"), ("tags", "array<string>")]


QUERIES = [
    TOTALS,
    "SELECT k, AVG(v) AS a, COUNT(v) AS c, MIN(v) AS lo, MAX(v) AS hi FROM raw.t GROUP BY k",
    "SELECT COUNT(*) AS n, SUM(v) AS s, COUNT(v) AS c FROM raw.t",
    "SELECT a.k, b.v FROM raw.t a JOIN raw.t b ON a.k = b.k AND a.j = b.j",
    "SELECT k, COUNT(DISTINCT v) AS d FROM raw.t GROUP BY k HAVING COUNT(*) > 1",
]
ROW = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None]), st.sampled_from([1, 2]))


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(first=st.lists(ROW, min_size=1, max_size=6), more=st.lists(ROW, min_size=1, max_size=4), gone=st.integers(0, 3))
def test_changes_equal_whole(spark, first, more, gone):
    p = project(spark, {f"q{i}": q for i, q in enumerate(QUERIES)}, first)
    p.apply()
    p.append("raw.t", table(spark, more))
    p.refresh()
    less = first[:gone]
    if less:
        p.delete("raw.t", table(spark, less))
        assert "full" not in set(p.refresh().values())
    for i, q in enumerate(QUERIES):
        assert rows(p.read(f"q{i}")) == rows(p.refresher.frame(q)), q


def test_diff_of_text_only():
    a, b = (State([Node(Name.parse("q"), q)]) for q in ("SELECT 1 AS x", "select  1 as x ;"))
    assert diff(a, b).empty


def test_concurrent_appends(spark):
    """Commits that race lose nothing, and a claim that a dead process left behind is taken over."""
    from concurrent.futures import ThreadPoolExecutor

    from millrace.sources import tables as module

    p = Project(spark, "race").init()
    p.attach("raw.t", table(spark, [("a", 1, 1)]))
    others = [Project(spark, "race", p.root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: others[k].tables.change(Name.parse("raw.t"), table(spark, [("b", k, i) for i in range(5)]), None), range(4)))
    assert p.tables.read("raw.t").count() == 21 and p.tables.version("raw.t") == 5
    p.tables.records.insert("claims", "raw.t-6", {"at": 0})
    p.tables.change("raw.t", table(spark, [("c", 1, 1)]), table(spark, [("a", 1, 1)]))
    assert p.tables.read("raw.t").count() == 21 and not p.tables.files.names("claims") and module.LEASE > 0


def test_lock_taken_over_once(spark):
    now = [0.0]
    p = Project(spark, "lock", clock=lambda: now[0]).init()
    p.catalog.lock("lock", "first", 10, [])
    with pytest.raises(errors.LockContention):
        p.catalog.lock("lock", "second", 10, [])
    now[0] = 20.0
    held = p.catalog.records.get("locks", "lock")
    p.catalog.records.insert("claims", f"lock-first-{held['acquired_at']}", {})  # another is taking it over
    with pytest.raises(errors.LockContention):
        p.catalog.lock("lock", "second", 10, [])
    p.catalog.records.remove("claims", f"lock-first-{held['acquired_at']}")
    p.catalog.lock("lock", "second", 10, [])
    assert p.catalog.holds("lock", "second")


def test_inputs_without_versions_fill_anew(spark):
    p = Project(spark, "loose").init()
    table(spark, [("a", 1, 1)]).createOrReplaceTempView("loose_t")
    p.define({"streams/q.sql": "SELECT k, COUNT(*) AS n FROM loose_t GROUP BY k"})
    node = Node(Name.parse("q"), "SELECT k, COUNT(*) AS n FROM loose_t GROUP BY k")
    refresher = Refresher(spark, p.tables)
    refresher.full(node)
    table(spark, [("a", 1, 1), ("a", 2, 2)]).createOrReplaceTempView("loose_t")
    assert refresher.refresh(node) == "full" and rows(p.tables.read(node.name)) == [("a", 2)]


def test_vacuum_spares_what_is_being_written(spark):
    p = project(spark, {"q": TOTALS})
    p.apply()
    folder = p.tables._write("raw.t", table(spark, [("x", 1, 1)]))  # written, not committed yet
    assert p.vacuum()["folders"] == 0
    assert p.vacuum(grace=0)["folders"] >= 1 and folder.rsplit("/", 1)[-1] not in p.tables.files.names("data/raw.t")
    assert rows(p.read("q")) == rows(spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "k string, s long, n long"))


def test_stored_batch_is_not_stored_again(spark):
    p = Project(spark, "batches").init()
    p.attach("raw.t", table(spark, [("a", 1, 1)]))
    for _ in range(2):
        p.tables.change("raw.t", table(spark, [("b", 1, 1)]), None, batch=("one", 0))
    p.tables.change("raw.t", table(spark, [("b", 1, 1)]), None, batch=("two", 0))
    assert p.tables.read("raw.t").count() == 3 and p.tables.batch("raw.t", "one") == 0 and p.tables.batch("raw.t", "three") == -1


def test_files_alike_on_every_file_system(spark, tmp_path):
    """The driver's own files and those that Spark's file systems reach behave alike."""
    from millrace.sources.storage import Files, LocalFiles, Records

    local = Files.at(spark, f"file://{tmp_path}/own")
    assert isinstance(local, LocalFiles) and isinstance(Files.at(spark, str(tmp_path)), LocalFiles)
    for files in (local, Files(spark, f"{tmp_path}/far")):
        records = Records(files)
        assert files.names("kind") == [] and records.get("kind", "a") is None and not records.remove("kind", "a")
        records.put("kind", "a", {"x": "ä"})
        records.put("kind", "a", {"x": "ö\n"})
        assert records.get("kind", "a") == {"x": "ö\n"} and files.names("kind") == ["a.json"]
        assert not records.insert("kind", "a", {}) and records.insert("kind", "b", {"y": 1})
        assert [records.append("numbered", {}) for _ in range(3)] == [1, 2, 3]
        assert [r["id"] for r in records.all("numbered")] == [1, 2, 3]
        assert files.exists("kind") and 0 <= files.age("kind/a.json") < 60
        assert files.delete("kind") and not files.exists("kind") and not files.delete("kind")


def test_distinct_on_is_refused(spark):
    from millrace.plans.shape import check_query

    with pytest.raises(errors.SqlParseError, match="DISTINCT ON"):
        check_query(spark, "SELECT DISTINCT ON (k) k, v FROM t", "q")
    assert check_query(spark, "SELECT DISTINCT k FROM t", "q").distinct


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    from millrace.__main__ import main

    shop = str(tmp_path / "shop")

    def call(*words):
        code = main([*words[:1], shop, *words[1:]], spark)
        return code, capsys.readouterr()

    assert call("status")[0] == 2  # no settings yet
    assert call("init")[0] == 0
    table(spark, [("a", 1, 1), ("a", 2, 2), ("b", 3, 3)]).write.parquet(str(tmp_path / "t"))
    assert call("attach", "--name", "raw.t", "--path", str(tmp_path / "t"))[0] == 0
    node = tmp_path / "shop" / "migrations" / "streams" / "q.sql"
    node.write_text("SELECT k, COUNT(*) AS n FROM raw.t GROUP BY k\n")
    assert call("validate")[0] == 0
    assert call("plan")[0] == 0 and call("plan", "--fail-if-changed")[0] == 1 and call("plan", "--fail-on-drift")[0] == 2
    assert call("plan", "--format", "nothing")[0] == 2
    assert call("diff")[0] == 0 and call("diff", "--fail-on-drift")[0] == 1
    assert call("apply", "--force-skip", "1")[0] == 2
    assert call("apply", "--allow-rebuild")[0] == 0
    assert call("diff", "--fail-on-drift")[0] == 0 and call("plan", "--fail-if-changed")[0] == 0
    assert call("refresh")[0] == 0
    code, said = call("audit", "--limit", "1")
    assert code == 0 and json.loads(said.out)["status"] == "committed"
    assert main(["--porcelain", "status", shop], spark) == 0 and json.loads(capsys.readouterr().out)["nodes"] == 1
    node.write_text("SELECT (k FROM raw.t\n")
    assert call("validate")[0] == 2
    node.write_text("SELECT k, COUNT(*) AS n FROM raw.t GROUP BY k\n")
    assert call("destroy")[0] == 2 and call("destroy", "--confirm")[0] == 0

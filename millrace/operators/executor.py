"""Execution of plans, step by step, with checkpoints, compensation and resumption."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import InvariantViolation, LockLost, MillraceError, ResumeError
from ..model import Mode, Name, Node, Plan, State, Step
from ..plans.shape import check_consumer, check_query, listed, relocate
from ..sources.catalog import Catalog, Heartbeat
from ..sources.tables import Tables
from .refresh import Refresher

ENGINE = "millrace 0.1"


def _node(spec: dict) -> Node:
    return State.from_json({"nodes": [spec]}).nodes[0]


class Executor:
    def __init__(self, spark: SparkSession, project: str, catalog: Catalog, tables: Tables, refresher: Refresher, emit=None, fail_at: int | None = None):
        self.spark, self.project, self.catalog, self.tables, self.refresher = spark, project, catalog, tables, refresher
        self.holder = f"{project}-{uuid.uuid4().hex[:12]}"
        self.emit = emit or (lambda e: print(json.dumps(e), file=sys.stderr))
        self.fail_at = fail_at  # for tests: the step that fails

    def execute(self, plan: Plan, dry_run: bool = False, resume: bool = False, force_skip: int | None = None, force_retry: int | None = None, sources: dict[str, str] | None = None) -> dict:
        """Runs the steps in order; a failure leaves a resumable migration behind."""
        if dry_run:
            return {"status": "dry-run", "steps": [s.describe() for s in plan.steps], "done": 0}
        migration, start = self._begin(plan, resume)
        self.plan, self.migration = plan, migration
        beat, done = None, 0
        try:
            for i, step in enumerate(plan.steps):
                if i < start and step.type != "LockDag" and i != force_retry:
                    continue
                if i == force_skip:
                    self._mark(i, step, "skipped")
                    self._progress(i)
                    continue
                if beat and (beat.lost.is_set() or not self.catalog.holds(self.project, self.holder)) and step.type != "UnlockDag":
                    raise LockLost(f"the lock of project '{self.project}' was lost before step {i}")
                self._mark(i, step, "running")
                self.emit({"event": "step_start", "step": i, "type": step.type, "target": step.target})
                began = time.time()
                try:
                    if i == self.fail_at:
                        raise InvariantViolation(f"step {i} was made to fail")
                    getattr(self, f"_{step.type}")(step.args)
                except Exception as e:
                    self._mark(i, step, "failed", str(e)[:500])
                    self.emit({"event": "step_failed", "step": i, "type": step.type, "error": str(e)[:500]})
                    raise
                if step.type == "LockDag":
                    beat = Heartbeat(self.catalog, self.project, self.holder, max(1.0, step.args.get("ttl", 30) / 3))
                self._mark(i, step, "completed")
                self._progress(i)
                done += 1
                self.emit({"event": "step_complete", "step": i, "type": step.type, "seconds": round(time.time() - began, 3)})
        except BaseException as e:
            self._finish("interrupted" if isinstance(e, KeyboardInterrupt) else "recoverable_failure")
            raise
        finally:
            if beat:
                beat.stop()
            self._resume_scheduler()
            self.catalog.unlock(self.project, self.holder)
        self._finish("committed")
        self.emit({"event": "apply_complete", "project": self.project, "version": plan.to_version, "steps": done})
        return {"status": "committed", "migration": migration, "done": done, "version": self.catalog.latest(self.project)}

    # bookkeeping

    def _begin(self, plan: Plan, resume: bool) -> tuple[int, int]:
        records = self.catalog.records
        if resume:
            open_ = [m for m in records.all("migrations") if m["project"] == self.project and m["status"] in ("running", "recoverable_failure", "interrupted")]
            if not open_:
                raise ResumeError(f"project '{self.project}' has no migration to resume")
            last = max(open_, key=lambda m: m["id"])
            if last["plan_hash"] != self._hash(plan):
                raise ResumeError("the plan differs from the one that was interrupted")
            for entry in sorted(records.all("ddl_log"), key=lambda r: -r["id"]):
                if entry["migration_id"] == last["id"] and entry["status"] == "running":
                    self._compensate(entry)
            records.put("migrations", last["id"], last | {"status": "running"})
            return last["id"], last["progress"] + 1
        value = {"project": self.project, "from_version": plan.from_version, "to_version": plan.to_version, "started_at": self.catalog.clock(), "status": "running", "plan": plan.to_json(), "plan_hash": self._hash(plan), "progress": -1, "engine": ENGINE, "plan_format": 1}
        return records.append("migrations", value), 0

    @staticmethod
    def _hash(plan: Plan) -> str:
        return hashlib.sha256(json.dumps(plan.to_json(), sort_keys=True).encode()).hexdigest()

    def _compensate(self, entry: dict) -> None:
        undo = entry.get("compensation") or {}
        if undo.get("action") == "remove_node":
            self.catalog.records.remove("nodes", undo["name"])
            self.tables.drop(undo["name"])
        elif undo.get("action") == "restore":
            self.catalog.records.put("nodes", undo["name"], undo["node"])
            if undo.get("table"):
                self.tables.records.put("tables", undo["name"], undo["table"])
        self.catalog.records.put("ddl_log", entry["id"], entry | {"status": "compensated"})

    def _logged(self, kind: str, name: str, text: str, undo: dict, action) -> None:
        """Runs an action between its log entry and the entry's completion."""
        at = self.catalog.log(kind, name, text, undo, self.migration, "running")
        action()
        entry = self.catalog.records.get("ddl_log", at)
        self.catalog.records.put("ddl_log", at, entry | {"status": "completed"})

    def _mark(self, i: int, step: Step, status: str, error: str | None = None) -> None:
        key = f"{self.migration:012d}-{i:05d}"
        self.catalog.records.put("steps", key, {"migration_id": self.migration, "step_index": i, "step_type": step.type, "step_hash": hashlib.sha256(json.dumps(step.args, sort_keys=True).encode()).hexdigest(), "status": status, "error": error, "at": self.catalog.clock()})

    def _progress(self, i: int) -> None:
        m = self.catalog.records.get("migrations", self.migration)
        self.catalog.records.put("migrations", self.migration, m | {"progress": max(i, m["progress"])})

    def _finish(self, status: str) -> None:
        m = self.catalog.records.get("migrations", self.migration)
        self.catalog.records.put("migrations", self.migration, m | {"status": status, "finished_at": self.catalog.clock()})

    def _resume_scheduler(self) -> None:
        for r in self.catalog.records.all("nodes"):
            if r["project"] == self.project and r.get("paused"):
                self.catalog.update_node(r["spec"]["name"], paused=False)

    # the steps

    def _LockDag(self, a):
        self.catalog.lock(self.project, self.holder, a["ttl"], a["nodes"])
        for name in a["nodes"]:
            if self.catalog.node(name):
                self.catalog.update_node(name, paused=True)

    def _UnlockDag(self, a):
        self._resume_scheduler()
        self.catalog.unlock(self.project, self.holder)

    def _ValidateQuery(self, a):
        check_query(self.spark, a["query"], a["name"])

    def _AlterBaseTable(self, a):
        """Brings the stored source to the declared columns: new ones are null, others go."""
        declared = ddl_columns(a["ddl"])
        if not declared or not self.tables.version(a["name"]):
            return
        df = self.tables.read(a["name"])
        if [c for c, _ in declared] != df.columns:
            cols = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in declared]
            self.tables.put(a["name"], df.select(*cols))

    def _CreateStreamTable(self, a):
        node = _node(a["spec"])

        def create():
            self.catalog.put_node(self.project, node)
            if not self.tables.version(node.name):
                self.tables.put(node.name, self.refresher.frame(node.query, closed=False).limit(0))

        self._logged("node", a["name"], f"create {a['name']}", {"action": "remove_node", "name": a["name"]}, create)

    def _AlterStreamTable(self, a):
        held = self.catalog.node(a["name"])
        spec = held["spec"] | {k: a[k] for k in ("schedule", "mode", "cdc", "query", "depends_on") if k in a}
        undo = {"action": "restore", "name": a["name"], "node": held}
        self._logged("node", a["name"], f"alter {a['name']}", undo, lambda: self.catalog.update_node(a["name"], spec=spec))

    def _DropStreamTable(self, a):
        held, table = self.catalog.node(a["name"]), self.tables.record(a["name"])
        if held is None:
            return
        if held["project"] != self.project:
            raise InvariantViolation(f"{a['name']} belongs to project {held['project']}")

        def drop():
            if a.get("rebuild"):
                self.catalog.records.put("policies", a["name"], {"policies": held.get("policies", [])})
            self.catalog.records.remove("nodes", a["name"])
            hidden = ((self.refresher.seen(a["name"]) or {}).get("hidden") or {}).values()
            if not a.get("rebuild"):  # a rebuilt node's versions go on counting, so that its readers see the change
                self.tables.drop(a["name"])
            for h in hidden:
                self.tables.drop(h)

        self._logged("node", a["name"], f"drop {a['name']}", {"action": "restore", "name": a["name"], "node": held, "table": table}, drop)

    def _Backfill(self, a):
        node = _node(self.catalog.node(a["name"])["spec"])
        if a["mode"] == "INCREMENTAL" and a.get("old_query"):
            self.refresher.evolve(node, a["old_query"])
        else:
            self.refresher.full(node)

    def _RecordSnapshot(self, a):
        self.catalog.record_version(self.project, a["spec"], {"steps": [s.describe() for s in self.plan.steps], "summary": self.plan.to_json()["summary"]}, self.plan.spec_hash)

    def _StartBlueGreenDeployment(self, a):
        self.catalog.records.put("deployments", self.project, {"project": self.project, "green": a["schema"], "blue": a["blue"], "status": "active", "started_at": self.catalog.clock(), "retire_at": None})

    def _CreateGreenSchema(self, a):
        self.catalog.records.put("schemas", a["schema"], {"created_at": self.catalog.clock()})

    def _green_query(self, query: str, schema: str) -> str:
        """Reads of nodes that are built in green go to green."""
        built = {n.removeprefix(f"{schema}.") for n in self.tables.known() if n.startswith(f"{schema}.")}
        return relocate(query, lambda n, _: f"{schema}.{_green(n)}" if _green(n) in built else None)

    def _CreateStreamTableInGreen(self, a):
        node = _node(a["spec"])
        green = Name(a["schema"], _green(node.name))
        self.refresher.full(Node(green, self._green_query(node.query, a["schema"]), node.mode))

    def _WaitForConvergence(self, a):
        """Builds are synchronous: every green node has a version over the inputs as they are."""
        for name in self.tables.known():
            if name.startswith(f"{a['schema']}."):
                seen = self.refresher.seen(name)
                if seen is None or any(self.tables.version(n) != v for n, v in seen["versions"].items()):
                    raise InvariantViolation(f"{name} has not converged")

    def _SwapConsumerViews(self, a):
        """Validates every view, then points nodes and views at green; a failure restores all of them."""
        for v in a["views"]:
            if v["body"]:
                check_consumer(self.spark, v["body"], v["name"])
        kept = {("nodes", n): self.catalog.node(n) for n in a["nodes"]} | {("tables", n): self.tables.record(n) for n in a["nodes"]} | {("views", v["name"]): self.catalog.records.get("views", v["name"]) for v in a["views"]}
        try:
            specs = {s["name"]: s for s in self._snapshot_spec()["nodes"]}
            for n in a["nodes"]:
                green = f"{a['schema']}.{_green(Name.parse(n))}"
                spec = _node(specs[n])
                versions = {str(x): v for x, _ in self.refresher._uses(spec.query) if (v := self.tables.version(x))}
                built = {k: v for k, v in self.tables.entry(green).items() if k not in ("plus", "minus", "touched")}
                self.tables.swap(n, built | {"full": True, "inputs": {"versions": versions, "query": spec.query, "hidden": {}}})
                self.catalog.put_node(self.project, spec)
            for v in a["views"]:
                self._view(v)
        except Exception:
            for (kind, key), value in kept.items():
                if value is None:
                    self.catalog.records.remove(kind, key)
                else:
                    self.catalog.records.put(kind, key, value)
            raise
        for name in a["drop_views"]:
            self.catalog.records.remove("views", name)
        d = self.catalog.records.get("deployments", self.project)
        self.catalog.records.put("deployments", self.project, d | {"status": "swapped", "swapped_at": self.catalog.clock()})

    def _snapshot_spec(self) -> dict:
        return next(s.args["spec"] for s in self.plan.steps if s.type == "RecordSnapshot")

    def _RetireBlueSchema(self, a):
        d = self.catalog.records.get("deployments", self.project)
        self.catalog.records.put("deployments", self.project, d | {"retire_at": self.catalog.clock() + a["retain_secs"]})

    def _view(self, v: dict) -> None:
        body = v["body"] or f"SELECT * FROM {v['source']}"
        check_consumer(self.spark, body, v["name"])
        self.refresher.frame(body, closed=False)  # must resolve
        self.catalog.records.put("views", v["name"], {"project": self.project, "consumer": v["consumer"], "expose_as": v["name"], "source": v["source"], "body": v["body"], "updated_at": self.catalog.clock()})

    def _ManageConsumerView(self, a):
        if a["action"] == "drop":
            self.catalog.records.remove("views", a["name"])
        else:
            self._view(a)

    def _RecreatePolicy(self, a):
        held = self.catalog.records.get("policies", a["name"])
        if held and self.catalog.node(a["name"]):
            self.catalog.update_node(a["name"], policies=held["policies"])

    def _DetachOutbox(self, a):
        self.catalog.log("outbox", a["name"], f"detach {a['outbox']}", None, self.migration)

    def _ReattachOutbox(self, a):
        self.catalog.log("outbox", a["name"], f"reattach {a['outbox']}", None, self.migration)

    def _ManageWalSlot(self, a):
        if a["action"] == "drop":
            self.catalog.records.remove("offsets", a["name"])
        else:
            self.catalog.records.put("offsets", a["name"], {"created_at": self.catalog.clock()})

    def _PauseImmediate(self, a):
        self._mode(a["name"], Mode.DIFFERENTIAL)

    def _ResumeImmediate(self, a):
        self._mode(a["name"], Mode.IMMEDIATE)

    def _mode(self, name: str, mode: Mode) -> None:
        held = self.catalog.node(name)
        if held:
            self.catalog.update_node(name, spec=held["spec"] | {"mode": str(mode)})

    def _WaitForRefresh(self, a):
        until = time.time() + a["deadline_secs"]
        while (self.catalog.node(a["name"]) or {}).get("status") == "running":
            if time.time() > until:
                raise MillraceError(f"{a['name']} was still refreshing after {a['deadline_secs']} s")
            time.sleep(0.5)

    def _RunHook(self, a):
        self.refresher.frame(a["sql"]).write.format("noop").mode("overwrite").save()


def _green(name: Name) -> str:
    return name.name if name.schema == "public" else f"{name.schema}__{name.name}"


#: Column types of source declarations and their Spark names.
TYPES = {
    "bigint": "bigint", "bigserial": "bigint", "int": "int", "integer": "int", "smallint": "smallint", "text": "string", "varchar": "string",
    "boolean": "boolean", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "numeric": "decimal(38,18)", "double precision": "double",
    "double": "double", "real": "float", "date": "date", "jsonb": "string", "bytea": "binary", "string": "string",
}


def ddl_columns(ddl: str) -> list[tuple[str, str]]:
    """(column, Spark type) of a CREATE TABLE text; constraints are left out."""
    m = re.search(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.\"]+\s*\((.*)\)", ddl or "")
    out = []
    for entry in listed(m[1]) if m else []:
        p = re.match(r"(?i)\s*(?!primary\b|foreign\b|unique\b|constraint\b|check\b)\"?(\w+)\"?\s+(double precision|[a-z_]+)\s*(\([\d\s,]+\))?(\[\])?", entry)
        if p:
            base = p[2].lower()
            kind = f"decimal{p[3].replace(' ', '')}" if base in ("numeric", "decimal") and p[3] else TYPES.get(base, base)
            out.append((p[1], f"array<{kind}>" if p[4] else kind))
    return out

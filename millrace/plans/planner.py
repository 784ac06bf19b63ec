"""From differences to an ordered list of steps."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ImmediateDowngradeRejected, JsonError, StalePlan
from ..model import Change, Class, Mode, Name, Node, Plan, State, Step, Strategy, Summary
from .classify import classify
from .dag import dependents, infer, promote_diamonds, topological
from .diff import Diff, NodeChange, diff

SYMBOLS = {"create": "+", "drop": "-"}


@dataclass
class Options:
    strategy: Strategy = Strategy.DEFAULT
    pre_hooks: list[str] = field(default_factory=list)
    post_hooks: list[str] = field(default_factory=list)
    no_immediate_downgrade: bool = False
    lock_ttl: int = 30


def spec_hash(state: State) -> str:
    return hashlib.sha256(json.dumps(state.to_json(), sort_keys=True).encode()).hexdigest()


def _spec(n: Node) -> dict:
    return State([n]).to_json()["nodes"][0]


def ordered(desired: State, live: State, changes: list[NodeChange]) -> list[NodeChange]:
    """Changes of nodes that stay or come in topological order, then drops from the last dependents on."""
    at = {n: i for i, n in enumerate(topological(desired))}
    back = {n: -i for i, n in enumerate(topological(live))}
    come = sorted((c for c in changes if c.kind != "drop"), key=lambda c: at[c.name])
    return come + sorted((c for c in changes if c.kind == "drop"), key=lambda c: back[c.name])


def build(spark: SparkSession, project: str, version: int | None, desired: State, live: State, options: Options | None = None) -> Plan:
    """The plan from live to desired.

    A rebuilt node's dependents are filled again after it, in topological order."""
    options = options or Options()
    infer(spark, desired)
    infer(spark, live)
    changes = diff(desired, live)
    classes = promote_diamonds(desired, {c.name: classify(spark, c) for c in changes.changes if c.kind not in ("create", "drop")})
    make = _blue_green if options.strategy == Strategy.BLUE_GREEN else _default
    steps, summary = make(spark, project, version, desired, live, changes, classes, options)
    return Plan(project, version, (version or 0) + 1, steps, summary, spec_hash(desired))


def _hooks(hooks: list[str], when: str) -> list[Step]:
    return [Step("RunHook", {"hook": f"{when}-{i}", "sql": sql}) for i, sql in enumerate(hooks)]


def _rebuild(n: Node, old: Node | None, options: Options, why: str) -> list[Step]:
    name = str(n.name)
    immediate = old is not None and old.mode == Mode.IMMEDIATE
    if immediate and options.no_immediate_downgrade:
        raise ImmediateDowngradeRejected(f"{name}: rebuilding needs a pause of IMMEDIATE mode")
    return [
        Step("ValidateQuery", {"name": name, "query": n.query}),
        *([Step("PauseImmediate", {"name": name})] if immediate else []),
        Step("WaitForRefresh", {"name": name, "deadline_secs": 60}),
        Step("DropStreamTable", {"name": name, "rebuild": True}),
        Step("CreateStreamTable", {"name": name, "spec": _spec(n)}),
        Step("RecreatePolicy", {"name": name}),
        Step("Backfill", {"name": name, "mode": "FULL", "why": why}),
        *([Step("ResumeImmediate", {"name": name})] if immediate and n.mode == Mode.IMMEDIATE else []),
    ]


def _default(spark, project, version, desired, live, changes: Diff, classes, options):
    s = Summary()
    steps = [Step("LockDag", {"project": project, "ttl": options.lock_ttl, "nodes": [str(c.name) for c in changes.changes]}), *_hooks(options.pre_hooks, "pre")]
    rebuilt: list[Name] = []
    stale: list[Name] = []  # nodes whose contents changed while dependents stay as they are

    def add(c_kind, name, cls, text, symbol=None):
        s.changes.append(Change(symbol or SYMBOLS.get(c_kind, "~"), str(name), c_kind, str(cls), text))

    for c in changes.sources:
        steps.append(Step("AlterBaseTable", {"name": str(c.name), "ddl": c.new.ddl}))
        s.sources += 1
        add("source", c.name, Class.REBUILD if c.impact else Class.FREE, f"alter source, {len(c.impact)} dependent nodes rebuilt")
        for name in c.impact:
            if name not in rebuilt and desired.node(name):
                rebuilt.append(name)
                steps += _rebuild(desired.node(name), live.node(name), options, "source changed")
                s.rebuild += 1
                s.destructive += 1
    for c in ordered(desired, live, changes.changes):
        name = str(c.name)
        if c.kind == "create":
            if c.new.query:
                steps.append(Step("ValidateQuery", {"name": name, "query": c.new.query}))
            steps += [Step("CreateStreamTable", {"name": name, "spec": _spec(c.new)}), Step("Backfill", {"name": name, "mode": str(c.new.mode), "why": "new"})]
            s.creates += 1
            add("create", c.name, Class.REBUILD, "create stream table")
        elif c.kind == "drop":
            steps.append(Step("WaitForRefresh", {"name": name, "deadline_secs": 60}))
            if c.old.cdc == "outbox":
                steps.append(Step("DetachOutbox", {"name": name, "outbox": f"{c.name.name}_outbox"}))
            if c.old.cdc == "wal":
                steps.append(Step("ManageWalSlot", {"name": name, "action": "drop"}))
            steps.append(Step("DropStreamTable", {"name": name}))
            s.drops += 1
            s.destructive += 1
            add("drop", c.name, Class.REBUILD, "drop stream table")
        else:
            cls = classes[c.name]
            s.alters += 1
            if c.name in rebuilt:
                add(c.kind, c.name, Class.REBUILD, "rebuilt with its source")
                continue
            alter = {f: getattr(c.new, f) if f != "mode" else str(c.new.mode) for f in c.fields}
            if cls == Class.REBUILD:
                steps += _rebuild(c.new, c.old, options, c.kind)
                s.rebuild += 1
                s.destructive += 1
                rebuilt.append(c.name)
                stale.append(c.name)
            elif c.kind == "query":
                steps += [
                    Step("ValidateQuery", {"name": name, "query": c.new.query}),
                    Step("AlterStreamTable", {"name": name, "query": c.new.query, "depends_on": [*map(str, c.new.depends_on)], **alter}),
                    Step("Backfill", {"name": name, "mode": "INCREMENTAL", "why": "columns", "old_query": c.old.query}),
                ]
                s.in_place += 1
                stale.append(c.name)
            else:
                steps.append(Step("AlterStreamTable", {"name": name, **alter}))
                s.free += cls == Class.FREE
                s.in_place += cls == Class.IN_PLACE
            add(c.kind, c.name, cls, f"alter {', '.join(c.fields) or 'query'}" if c.kind != "query" else "alter query")
    touched = {c.name for c in changes.changes} | set(rebuilt)
    for name in dependents(desired, stale):
        if name not in touched and live.node(name):
            steps.append(Step("Backfill", {"name": str(name), "mode": "FULL", "why": "upstream rebuilt"}))
    for c in changes.consumers:
        spec = c.new or c.old
        steps.append(Step("ManageConsumerView", {"name": str(c.name), "action": c.kind, "source": str(spec.source), "body": spec.body, "consumer": str(spec.name)}))
        s.consumers += 1
        add("consumer", c.name, Class.FREE, f"{c.kind} consumer view", {"create": "+", "drop": "-"}.get(c.kind, "~"))
    steps += [*_hooks(options.post_hooks, "post"), Step("RecordSnapshot", {"version": (version or 0) + 1, "spec": desired.to_json()}), Step("UnlockDag", {"project": project})]
    return steps, s


def _blue_green(spark, project, version, desired, live, changes: Diff, classes, options):
    """Changed nodes and what depends on them are built beside the old ones; views move over at once."""
    s = Summary()
    base = project.replace("-", "_")
    green, blue = f"{base}__v{(version or 0) + 1}", f"{base}__v{version or 0}"
    changed = [c for c in changes.changes if c.new is not None]
    moved = {c.name for c in changed} | set(dependents(desired, [c.name for c in changed if c.kind != "unchanged"]))
    steps = [Step("LockDag", {"project": project, "ttl": options.lock_ttl, "nodes": [str(n) for n in moved]}), *_hooks(options.pre_hooks, "pre")]
    steps += [Step("AlterBaseTable", {"name": str(c.name), "ddl": c.new.ddl}) for c in changes.sources]
    s.sources = len(changes.sources)
    steps += [Step("StartBlueGreenDeployment", {"project": project, "schema": green, "blue": blue}), Step("CreateGreenSchema", {"schema": green})]
    for name in topological(desired):
        if name in moved:
            n = desired.node(name)
            steps += [Step("ValidateQuery", {"name": str(name), "query": n.query}), Step("CreateStreamTableInGreen", {"name": str(name), "schema": green, "spec": _spec(n)})]
    steps.append(Step("WaitForConvergence", {"schema": green, "timeout_secs": 300, "poll_ms": 500}))
    views = [{"name": str(c.expose_as), "source": str(c.source), "body": c.body, "consumer": str(c.name)} for c in desired.consumers]
    drops = [str(c.name) for c in changes.consumers if c.kind == "drop"]
    steps.append(Step("SwapConsumerViews", {"schema": green, "nodes": sorted(map(str, moved)), "views": views, "drop_views": drops, "project": project}))
    for c in ordered(desired, live, [c for c in changes.changes if c.kind == "drop"]):
        steps += [Step("WaitForRefresh", {"name": str(c.name), "deadline_secs": 60}), Step("DropStreamTable", {"name": str(c.name)})]
        s.drops += 1
    steps.append(Step("RetireBlueSchema", {"schema": blue, "retain_secs": 3600}))
    for c in changes.changes:
        kind = c.kind
        s.creates += kind == "create"
        s.alters += kind not in ("create", "drop")
        s.blue_green += kind != "drop"
        s.changes.append(Change(SYMBOLS.get(kind, "~"), str(c.name), kind, str(Class.BLUE_GREEN if kind != "drop" else Class.REBUILD), f"{kind} by blue/green"))
    for c in changes.consumers:
        s.consumers += 1
        s.changes.append(Change(SYMBOLS.get(c.kind, "~"), str(c.name), "consumer", "free", f"{c.kind} consumer view"))
    steps += [*_hooks(options.post_hooks, "post"), Step("RecordSnapshot", {"version": (version or 0) + 1, "spec": desired.to_json()}), Step("UnlockDag", {"project": project})]
    return steps, s


def step_counts(plan: Plan) -> dict[str, int]:
    return dict(Counter(s.type for s in plan.steps))


def step_rows(spark: SparkSession, plan: Plan) -> DataFrame:
    rows = [(i, s.type, s.target, s.describe()) for i, s in enumerate(plan.steps)]
    return spark.createDataFrame(rows, "idx int, step_type string, target string, detail string")


def save(plan: Plan) -> str:
    return json.dumps(plan.to_json(), indent=2, sort_keys=True)


def restore(text: str, desired: State | None = None) -> Plan:
    """A saved plan; one made for another desired state is refused (a plan without a hash is not)."""
    try:
        plan = Plan.from_json(json.loads(text))
    except (ValueError, KeyError, TypeError) as e:
        raise JsonError(str(e)) from e
    if desired is not None and plan.spec_hash and plan.spec_hash != spec_hash(desired):
        raise StalePlan("the project has changed since this plan was made")
    return plan

"""A project: the commands over its graph."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataLossRequired, FullRefreshNotAllowed, MaintenanceWindow, MillraceError, OwnershipRequired
from ..functions import fmt, lint, validate
from ..model import Mode, Name, Node, Plan, State, Strategy
from ..plans import cost, dag, planner
from ..plans.diff import Diff, diff, diff_rows
from ..sources import project as files
from ..sources.catalog import Catalog
from ..sources.config import Config, in_window, seconds
from ..sources.storage import scratch
from ..sources.tables import Tables
from .executor import Executor
from .refresh import Refresher


class Project:
    """One project on one warehouse folder. Files or a State say what is wanted; the catalog says what is there."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, config: Config | None = None, clock=time.time, emit=lambda e: None):
        self.spark, self.name, self.root = spark, name, root or scratch(spark, name)
        self.config = config or Config(name)
        self.tables = Tables(spark, self.root)
        self.catalog = Catalog(spark, self.tables.records, clock)
        self.refresher = Refresher(spark, self.tables)
        self.clock, self.emit = clock, emit
        self._desired = State()

    # set-up

    def init(self, directory: str | Path | None = None) -> Project:
        """Creates or upgrades the catalog and, if wanted, a skeleton of project files."""
        self.catalog.upgrade()
        if directory:
            for part in ("streams", "sources", "consumers"):
                (Path(directory) / "migrations" / part).mkdir(parents=True, exist_ok=True)
            settings = Path(directory) / "millrace.toml"
            if not settings.exists():
                settings.write_text(f'[project]\nname = "{self.name}"\n')
        return self

    def load(self, directory: str | Path, values: dict[str, str] | None = None) -> Project:
        self.files = files.load(directory, values)
        return self.want(dag.build(self.spark, self.files))

    def want(self, state: State) -> Project:
        self._desired = dag.infer(self.spark, state)
        dag.topological(state)
        return self

    def define(self, texts: dict[str, str]) -> Project:
        """Desired state from file texts by path, such as streams/totals.sql."""
        self.files = [files.parse(p, t) for p, t in texts.items()]
        return self.want(dag.build(self.spark, self.files))

    def attach(self, name: str, df_or_path: DataFrame | str) -> None:
        """A source's rows: existing Parquet files, whose folder every refresh lists again, or a DataFrame to store."""
        if isinstance(df_or_path, str):
            self.tables.attach(Name.parse(name), df_or_path)
        else:
            self.tables.put(Name.parse(name), df_or_path)

    # plan and apply

    def live(self) -> State:
        return dag.infer(self.spark, self.catalog.live(self.name))

    def diff(self) -> Diff:
        return diff(self._desired, self.live())

    def diff_rows(self) -> DataFrame:
        return diff_rows(self.spark, self._desired, self.live())

    def plan(self, strategy: str | None = None, no_immediate_downgrade: bool = False) -> Plan:
        a = self.config.apply
        ttl = seconds(a.lock_timeout) or 30
        options = planner.Options(Strategy(strategy or a.default_strategy), a.pre_hooks, a.post_hooks, no_immediate_downgrade, ttl)
        return planner.build(self.spark, self.name, self.catalog.latest(self.name), self._desired, self.live(), options)

    def cost(self, plan: Plan) -> list[cost.StepCost]:
        def rows(name: str, query: str) -> int | None:
            try:
                return cost.estimated_rows(self.spark, self.refresher.frame(query, closed=False))
            except Exception:
                return None

        return cost.plan_cost(plan, rows)

    def gate(self, plan: Plan, allow_rebuild: bool) -> None:
        """Refuses rebuilds that are not allowed and expensive plans outside the maintenance window."""
        a, s = self.config.apply, plan.summary
        if s.rebuild and not a.allow_full_refresh and not allow_rebuild:
            raise FullRefreshNotAllowed(f"{s.rebuild} rebuild steps; allow them in the configuration or for this run")
        heavy = {"rebuild": s.rebuild, "blue-green": s.blue_green, "in-place": s.in_place, "free": s.free}
        if a.maintenance_window and any(heavy.get(k) for k in a.applies_to) and not in_window(a.maintenance_window, datetime.fromtimestamp(self.clock(), UTC)):
            raise MaintenanceWindow(f"deferred to {a.maintenance_window}")

    def apply(self, plan: Plan | None = None, allow_rebuild: bool = True, dry_run: bool = False, resume: bool = False, strategy: str | None = None, fail_at: int | None = None, **force) -> dict:
        if plan is None and resume:
            open_ = [m for m in self.catalog.records.all("migrations") if m["project"] == self.name and m["status"] != "committed"]
            plan = Plan.from_json(max(open_, key=lambda m: m["id"])["plan"]) if open_ else None
        plan = plan or self.plan(strategy)
        if plan.empty and not resume:
            return {"status": "empty", "done": 0}
        if not dry_run:
            self.gate(plan, allow_rebuild)
            self.catalog.upgrade()
        return Executor(self.spark, self.name, self.catalog, self.tables, self.refresher, self.emit, fail_at).execute(plan, dry_run, resume, **force)

    def rollback(self, version: int | None = None, allow_rebuild: bool = False, accept_data_loss: bool = False) -> dict:
        """Brings back an earlier version's graph as a new version."""
        current = self.catalog.latest(self.name)
        version = version or (current - 1 if current else 0)
        record = self.catalog.version_record(self.name, version) if version > 0 else None
        if record is None or version >= current:
            raise MillraceError(f"no version {version} to roll back to from {current}")
        self._desired = State.from_json(record["spec"])
        plan = self.plan()
        risk = self.risk(plan)
        if risk == "data-loss" and not accept_data_loss:
            raise DataLossRequired("rolling back rebuilds tables whose history is older; accept the loss to go on")
        return self.apply(plan, allow_rebuild=allow_rebuild or risk != "safe") | {"risk": risk}

    def risk(self, plan: Plan) -> str:
        if not plan.summary.rebuild:
            return "safe"
        age = self.clock() - self.catalog.version_record(self.name)["applied_at"]
        return "point-in-time" if age < 3600 else "data-loss"

    # data

    def read(self, name: str) -> DataFrame:
        """A node, a source, or a consumer view by the name it exposes."""
        view = self.catalog.records.get("views", str(Name.parse(name)))
        if view:
            return self.refresher.frame(view["body"] or f"SELECT * FROM {view['source']}")
        return self.tables.read(Name.parse(name))

    def register_views(self) -> list[str]:
        """Consumer views as temporary views of the session, dots as underscores."""
        names = []
        for r in self.catalog.records.all("views"):
            names.append(r["expose_as"].replace(".", "_"))
            self.read(r["expose_as"]).createOrReplaceTempView(names[-1])
        return names

    def append(self, source: str, rows: DataFrame) -> None:
        """Adds rows to a source; IMMEDIATE nodes that read it follow at once."""
        self._change(source, rows, None)

    def delete(self, source: str, rows: DataFrame) -> None:
        self._change(source, None, rows)

    def _change(self, source: str, plus: DataFrame | None, minus: DataFrame | None) -> None:
        name = Name.parse(source)
        self.tables.change(name, plus, minus)
        live = self.live()
        reached = dag.dependents(live, [name])
        wanted = [n for n in reached if live.node(n).mode == Mode.IMMEDIATE]
        needed = {a for n in wanted for a in dag.ancestors(live, n)} | set(wanted)
        for n in dag.topological(live):
            if n in needed:
                self._refresh(live.node(n))

    def _refresh(self, node: Node) -> str:
        held = self.catalog.node(node.name)
        if held and held.get("paused"):
            return "paused"
        self.catalog.update_node(node.name, status="running")
        try:
            return self.refresher.refresh(node)
        finally:
            self.catalog.update_node(node.name, status="idle", refreshed_at=self.clock())

    def refresh(self, names: list[str] | None = None) -> dict[str, str]:
        """Refreshes nodes (all, or the named ones and what they read) in order; says how each was done."""
        live = self.live()
        wanted = {Name.parse(n) for n in names} if names else {n.name for n in live.nodes}
        wanted |= {a for n in wanted for a in dag.ancestors(live, n)}
        self.sync(live, wanted)
        return {str(n): self._refresh(live.node(n)) for n in dag.topological(live) if n in wanted}

    def sync(self, live: State | None = None, nodes: set[Name] | None = None) -> dict[str, str]:
        """Takes in the new files of attached folders that the nodes (or all) read; says what was found."""
        live = live or self.live()
        own = {n.name for n in live.nodes}
        sources = {d for n in live.nodes if nodes is None or n.name in nodes for d in n.depends_on} - own
        return {str(s): self.tables.sync(s) for s in sorted(sources, key=str)}

    def refresh_due(self, now: float | None = None) -> dict[str, str]:
        """Refreshes the nodes whose schedule has run out; a schedule that is no interval follows its readers."""
        now = now or self.clock()
        live, out = self.live(), {}
        for n in dag.topological(live):
            node, held = live.node(n), self.catalog.node(n)
            every = seconds(node.schedule)
            readers = [seconds(live.node(d).schedule) for d in dag.dependents(live, [n])]
            every = every if every is not None else min((r for r in readers if r is not None), default=30)
            if now - held.get("refreshed_at", 0) >= every:
                out[str(n)] = self._refresh(node)
        return out

    # inspection

    def status(self) -> dict:
        d, version = self.diff(), self.catalog.latest(self.name)
        record = self.catalog.version_record(self.name) or {}
        drift = len(d.changes) + len(d.sources) + len(d.consumers)
        return {"project": self.name, "version": version, "applied_at": record.get("applied_at"), "applied_by": record.get("applied_by"), "nodes": len(self.live().nodes), "drift": drift}

    def watch(self, interval: float, rounds: int, sleep=time.sleep, max_drift: int | None = None) -> list[dict]:
        """Status again and again; while there is no change the pause doubles up to five intervals."""
        out, quiet = [], 0
        for _ in range(rounds):
            report = self.status()
            quiet = quiet + 1 if out and report["drift"] == out[-1]["drift"] else 0
            out.append(report)
            if max_drift is not None and report["drift"] > max_drift:
                break
            sleep(min(interval * 2**quiet, 5 * interval))
        return out

    def audit(self, limit: int = 50) -> DataFrame:
        return self.catalog.history(self.name, limit)

    def validate(self):
        return validate.check(self.spark, self.files, self._desired)

    def lint(self):
        return lint.check(self.spark, self.files, self._desired)

    def format(self, check_only: bool = False) -> list[str]:
        """Paths whose canonical form differs; they are rewritten unless only checked."""
        changed = []
        for f in self.files:
            text, path = fmt.render(f), Path(f.path)
            if path.exists() and path.read_text() != text:
                changed.append(f.path)
                if not check_only:
                    path.write_text(text)
        return changed

    def unlock(self, force: bool = False) -> bool:
        held = self.catalog.records.get("locks", self.name)
        if not held:
            return False
        if not force and held["acquired_at"] + held["ttl"] > self.clock():
            raise MillraceError(f"the lock is held by '{held['holder']}'; force its removal if that run is gone")
        return self.catalog.unlock(self.name)

    # other graphs

    def destroy(self, dry_run: bool = False, force_cascade: bool = False) -> list[str]:
        """Drops every node of the project, dependents first, its views and its records."""
        live = self.live()
        order = [str(n) for n in reversed(dag.topological(live))]
        other = [r["spec"]["name"] for r in self.catalog.records.all("nodes") if r["project"] != self.name and any(str(d) in order for d in dag.references(self.spark, r["spec"]["query"]))]
        if other and not force_cascade:
            raise OwnershipRequired(f"nodes of other projects read these: {', '.join(other)}")
        if dry_run:
            return order
        for name in order:
            self.catalog.records.remove("nodes", name)
            for h in ((self.refresher.seen(name) or {}).get("hidden") or {}).values():
                self.tables.drop(h)
            self.tables.drop(name)
        for r in self.catalog.records.all("views"):
            if r["project"] == self.name:
                self.catalog.records.remove("views", r["expose_as"])
        for kind in ("locks", "deployments"):
            self.catalog.records.remove(kind, self.name)
        self.tables.files.delete(f"versions/{self.name}")
        return order

    def vacuum(self, grace: float = 3600.0) -> dict:
        """Drops blue/green leftovers whose time has come, merges tables of many folders, then removes files that no version
        names and no refresh can be writing."""
        gone = []
        d = self.catalog.records.get("deployments", self.name)
        if d and d["status"] == "swapped" and d["retire_at"] and d["retire_at"] <= self.clock():
            # the folders of green versions are the nodes' own now; only the records go
            for n in self.tables.known():
                if n.startswith((f"{d['green']}.", f"{d['blue']}.")):
                    self.tables.drop(n)
                    gone.append(n)
            self.catalog.records.put("deployments", self.name, d | {"status": "retired"})
        for n in self.tables.known():
            self.tables.merge(n)
        return {"tables": gone, "folders": self.tables.vacuum(grace)}

    def promote(self, to: Project, allow_rebuild: bool = True) -> dict:
        """Applies this project's recorded graph to another warehouse; this one must be clean."""
        if not self.diff().empty or self.catalog.latest(self.name) is None:
            raise MillraceError(f"project '{self.name}' has changes that are not applied, or no version")
        to.want(State.from_json(self.catalog.version_record(self.name)["spec"]))
        return to.apply(allow_rebuild=allow_rebuild)

    def export(self, directory: str | Path, exclude: str | None = None) -> int:
        """Project files of the live nodes; names of other schemas than the default carry it."""
        n, streams = 0, Path(directory) / "migrations" / "streams"
        streams.mkdir(parents=True, exist_ok=True)
        for node in self.live().nodes:
            if exclude and re.search(exclude, str(node.name)):
                continue
            d = {"schema": node.name.schema, "schedule": node.schedule, "refresh_mode": str(node.mode)} | ({"cdc_mode": node.cdc} if node.cdc else {})
            folder = streams if node.name.schema == "public" else streams / node.name.schema
            folder.mkdir(exist_ok=True)
            path = folder / f"{node.name.name}.sql"
            path.write_text(fmt.render(files.ProjectFile(str(path), node.query, "stream", d)))
            n += 1
        settings = Path(directory) / "millrace.toml"
        if not settings.exists():
            settings.write_text(f'[project]\nname = "{self.name}"\n')
        return n

    def preview(self, branch: str, fraction: float = 0.1, anchor: str | None = None, seed: int = 42, keys: dict[str, str] | None = None) -> Project:
        """A scratch project on samples of the sources, with the whole graph or the part around an anchor.

        A source named in `keys` is sampled by the hash of that column, so the same rows come again whatever
        the partitions are, and sources that share a key keep rows that join; others are sampled by the seed."""
        safe = re.sub(r"[^a-z0-9_]", "_", branch.lower())
        out = Project(self.spark, f"{self.name}_preview_{safe}", f"{self.root}/previews/{safe}", self.config, self.clock, self.emit)
        part = dag.subgraph(self._desired, Name.parse(anchor)) if anchor else {n.name for n in self._desired.nodes}
        nodes = [n for n in self._desired.nodes if n.name in part]
        share = min(max(fraction, 0.0001), 1.0)
        by = {Name.parse(n): column for n, column in (keys or {}).items()}
        for name in {d for n in nodes for d in n.depends_on} - part:
            if self.tables.version(name):
                rows, key = self.tables.read(name), by.get(name)
                if share < 1 and key:
                    rows = rows.where(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8) < f"{int(share * 2**32):08x}")
                elif share < 1:
                    rows = rows.sample(False, share, seed)
                out.tables.put(name, rows)
        out.init().want(State(nodes, self._desired.sources))
        out.apply()
        return out

    def previews(self) -> list[str]:
        return self.tables.files.names("previews")

    def drop_preview(self, branch: str) -> bool:
        return self.tables.files.delete(f"previews/{re.sub(r'[^a-z0-9_]', '_', branch.lower())}")

"""The project catalog: versions, migrations, steps, locks, ownership, views, deployments, logs."""

from __future__ import annotations

import getpass
import threading
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError, LockContention
from ..model import Consumer, Name, Node, Source, State
from .storage import Records

CATALOG_VERSION = 9


def now() -> float:
    return time.time()


class Catalog:
    """Records below the project's root. Live nodes are records of their own; versions are per project."""

    def __init__(self, spark: SparkSession, records: Records, clock=now):
        self.spark, self.records, self.clock = spark, records, clock

    def upgrade(self) -> int:
        """Brings the catalog to the current version, one step at a time; the number of steps taken."""
        at = (self.records.get("profile", "catalog") or {"version": 0})["version"]
        if at > CATALOG_VERSION:
            raise CatalogError(f"catalog version {at} is newer than this engine ({CATALOG_VERSION})")
        for v in range(at + 1, CATALOG_VERSION + 1):
            self.records.put("profile", "catalog", {"version": v, "measured_at": self.clock()})
        return CATALOG_VERSION - at

    # live state

    def put_node(self, project: str, node: Node, **more) -> None:
        held = self.records.get("nodes", str(node.name)) or {}
        if held and held["project"] != project:
            raise CatalogError(f"{node.name} belongs to project {held['project']}")
        spec = State([node]).to_json()["nodes"][0]
        self.records.put("nodes", str(node.name), {"managed_since": self.clock(), "status": "idle", "paused": False, "policies": []} | held | {"project": project, "spec": spec} | more)

    def node(self, name: Name | str) -> dict | None:
        return self.records.get("nodes", str(name))

    def update_node(self, name: Name | str, **more) -> None:
        held = self.node(name)
        if held is None:
            raise CatalogError(f"no node {name}")
        self.records.put("nodes", str(name), held | more)

    def live(self, project: str | None = None) -> State:
        """Nodes and consumers of a project, sources as its last version recorded them."""
        nodes = [r for r in self.records.all("nodes") if project in (None, r["project"])]
        state = State.from_json({"nodes": sorted((r["spec"] for r in nodes), key=lambda s: s["name"])})
        views = [r for r in self.records.all("views") if project in (None, r["project"])]
        state.consumers = [Consumer(*(Name.parse(r[k]) for k in ("consumer", "source", "expose_as")), r["body"]) for r in views]
        last = self.version_record(project) if project else None
        if last:
            state.sources = [Source(Name.parse(s["name"]), s["owned"], s["ddl"]) for s in last["spec"]["sources"]]
        return state

    def node_count(self) -> int:
        return len(self.records.files.names("nodes"))

    # versions

    def latest(self, project: str) -> int | None:
        names = self.records.files.names(f"versions/{project}")
        return int(names[-1].removesuffix(".json")) if names else None

    def version_record(self, project: str, version: int | None = None) -> dict | None:
        version = version or self.latest(project)
        return self.records.get(f"versions/{project}", version) if version else None

    def record_version(self, project: str, spec: dict, plan: dict, spec_hash: str) -> int:
        value = {"project": project, "spec": spec, "plan": plan, "spec_hash": spec_hash, "applied_at": self.clock(), "applied_by": getpass.getuser()}
        return self.records.append(f"versions/{project}", value)

    # lock

    def lock(self, project: str, holder: str, ttl: float, nodes: list[str]) -> None:
        value = {"project": project, "holder": holder, "acquired_at": self.clock(), "ttl": ttl, "paused_nodes": nodes}
        if self.records.insert("locks", project, value):
            return
        held = self.records.get("locks", project)
        if held and held["holder"] != holder and held["acquired_at"] + held["ttl"] > self.clock():
            raise LockContention(f"lock of project '{project}' is held by '{held['holder']}'")
        # expired: of all that find it so, one may take it over, and only if it is still the same lock
        claim = f"{project}-{held['holder']}-{held['acquired_at']}" if held else f"{project}-none"
        if not self.records.insert("claims", claim, value):
            raise LockContention(f"lock of project '{project}' is being taken over")
        try:
            if self.records.get("locks", project) != held:
                raise LockContention(f"lock of project '{project}' was taken over")
            self.records.put("locks", project, value)
        finally:
            self.records.remove("claims", claim)

    def renew(self, project: str, holder: str) -> bool:
        held = self.records.get("locks", project)
        if not held or held["holder"] != holder:
            return False
        self.records.put("locks", project, held | {"acquired_at": self.clock()})
        return True

    def holds(self, project: str, holder: str) -> bool:
        held = self.records.get("locks", project)
        return bool(held) and held["holder"] == holder

    def unlock(self, project: str, holder: str | None = None) -> bool:
        held = self.records.get("locks", project)
        return bool(held) and holder in (None, held["holder"]) and self.records.remove("locks", project)

    # history

    def log(self, kind: str, name: str, text: str, undo: dict | None = None, migration: int | None = None, status: str = "completed") -> int:
        return self.records.append("ddl_log", {"object_type": kind, "object_name": name, "command_text": text, "compensation": undo, "migration_id": migration, "status": status, "recorded_at": self.clock()})

    def ddl_log(self, limit: int) -> list[dict]:
        return sorted(self.records.all("ddl_log"), key=lambda r: -r["id"])[:limit]

    def history(self, project: str, limit: int = 50) -> DataFrame:
        """Migrations with their step counts, newest first, as a query over the records."""
        m = [(r["id"], r["project"], r["status"], _ts(r["started_at"]), _ts(r.get("finished_at")), r.get("to_version"), r.get("engine", "")) for r in self.records.all("migrations")]
        s = [(r["migration_id"], r["step_index"], r["status"], r.get("error")) for r in self.records.all("steps")]
        migrations = self.spark.createDataFrame(m, "migration_id long, project string, status string, started_at timestamp, finished_at timestamp, to_version long, cli_version string")
        steps = self.spark.createDataFrame(s, "migration_id long, step_index int, step_status string, error string")
        joined = migrations.join(steps, "migration_id", "left").where(F.col("project") == project)
        grouped = joined.groupBy(*migrations.columns).agg(
            F.count("step_index").alias("step_count"),
            F.sum((F.col("step_status") == "failed").cast("long")).alias("failed_steps"),
            F.max("error").alias("last_error"),
        )
        return grouped.orderBy(F.desc("started_at"), F.desc("migration_id")).limit(limit)


def _ts(seconds: float | None) -> datetime | None:
    return datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None) if seconds else None


class Heartbeat:
    """Renews a lock in the background; lost is set when it is no longer ours."""

    def __init__(self, catalog: Catalog, project: str, holder: str, every: float = 10):
        self.lost, self._stop = threading.Event(), threading.Event()

        def beat():
            while not self._stop.wait(every):
                try:
                    if not catalog.renew(project, holder):
                        self.lost.set()
                        return
                except Exception:
                    self.lost.set()
                    return

        self._thread = threading.Thread(target=beat, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(timeout=5)

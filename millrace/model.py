"""Names, node specifications, states, plans: small values on the driver."""

from __future__ import annotations

import enum
from dataclasses import asdict, dataclass, field

from .errors import ConfigError

DEFAULT_SCHEMA, DEFAULT_SCHEDULE = "public", "30s"


@dataclass(frozen=True, order=True)
class Name:
    schema: str
    name: str

    @classmethod
    def parse(cls, text: str) -> Name:
        """schema.name at the first dot; a bare name is in the default schema."""
        left, dot, right = text.partition(".")
        return cls(left, right) if dot else cls(DEFAULT_SCHEMA, text)

    def __str__(self) -> str:
        return f"{self.schema}.{self.name}"


class Mode(enum.StrEnum):
    DIFFERENTIAL = "DIFFERENTIAL"
    FULL = "FULL"
    IMMEDIATE = "IMMEDIATE"

    @classmethod
    def parse(cls, text: str) -> Mode:
        try:
            return cls(text.upper())
        except ValueError:
            raise ConfigError(f"unknown refresh mode '{text}'") from None


class Class(enum.IntEnum):
    """What a change costs, in order."""

    FREE = 0
    IN_PLACE = 1
    REBUILD = 2
    BLUE_GREEN = 3

    def __str__(self) -> str:
        return ("free", "in-place", "rebuild", "blue-green")[self]


class Strategy(enum.StrEnum):
    DEFAULT = "default"
    BLUE_GREEN = "blue-green"


@dataclass
class Node:
    name: Name
    query: str
    mode: Mode = Mode.DIFFERENTIAL
    schedule: str = DEFAULT_SCHEDULE
    cdc: str | None = None
    depends_on: list[Name] = field(default_factory=list)
    explicit: list[Name] = field(default_factory=list)


@dataclass
class Source:
    name: Name
    owned: bool = False
    ddl: str = ""


@dataclass
class Consumer:
    name: Name
    source: Name
    expose_as: Name
    body: str = ""


@dataclass
class State:
    """Desired, live or recorded graph."""

    nodes: list[Node] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    consumers: list[Consumer] = field(default_factory=list)

    def node(self, name: Name) -> Node | None:
        return next((n for n in self.nodes if n.name == name), None)

    def source(self, name: Name) -> Source | None:
        return next((s for s in self.sources if s.name == name), None)

    def consumer(self, expose_as: Name) -> Consumer | None:
        return next((c for c in self.consumers if c.expose_as == expose_as), None)

    def to_json(self) -> dict:
        text = lambda x: str(x) if isinstance(x, Name | enum.Enum) else [text(y) for y in x] if isinstance(x, list) else x
        rows = lambda items: [{k: text(getattr(i, k)) for k in i.__dataclass_fields__} for i in items]
        return {"nodes": rows(self.nodes), "sources": rows(self.sources), "consumers": rows(self.consumers)}

    @classmethod
    def from_json(cls, data: dict) -> State:
        nodes = [
            Node(Name.parse(n["name"]), n["query"], Mode.parse(n["mode"]), n["schedule"], n["cdc"], [*map(Name.parse, n["depends_on"])], [*map(Name.parse, n["explicit"])])
            for n in data.get("nodes", [])
        ]
        sources = [Source(Name.parse(s["name"]), s["owned"], s["ddl"]) for s in data.get("sources", [])]
        consumers = [Consumer(*(Name.parse(c[k]) for k in ("name", "source", "expose_as")), c["body"]) for c in data.get("consumers", [])]
        return cls(nodes, sources, consumers)


@dataclass
class Step:
    """One step of a plan: its type and arguments, all of JSON types."""

    type: str
    args: dict = field(default_factory=dict)

    @property
    def target(self) -> str:
        a = self.args
        return a.get("name") or a.get("project") or a.get("schema") or str(a.get("version", ""))

    def describe(self) -> str:
        a = self.args
        texts = {
            "LockDag": "Acquire lock for project '{project}'",
            "ValidateQuery": "Validate query for '{name}'",
            "AlterBaseTable": "ALTER base table '{name}'",
            "CreateStreamTable": "CREATE stream table '{name}'",
            "AlterStreamTable": "ALTER stream table '{name}'",
            "DropStreamTable": "DROP stream table '{name}'",
            "Backfill": "BACKFILL '{name}' ({mode})",
            "RecordSnapshot": "Record DAG version {version}",
            "UnlockDag": "Release lock",
            "CreateGreenSchema": "CREATE SCHEMA '{schema}' (green)",
            "CreateStreamTableInGreen": "CREATE stream table '{name}' in green schema '{schema}'",
            "WaitForConvergence": "Wait for green schema '{schema}' to converge",
            "SwapConsumerViews": "Swap consumer views → '{schema}'",
            "RetireBlueSchema": "Retire blue schema '{schema}' (after {retain_secs}s)",
            "StartBlueGreenDeployment": "Start blue/green deployment for '{project}' → '{schema}'",
            "ManageConsumerView": "{action} consumer view '{name}' → '{source}'",
            "RecreatePolicy": "RECREATE policy on '{name}'",
            "DetachOutbox": "DETACH outbox '{outbox}' from '{name}'",
            "ReattachOutbox": "REATTACH outbox '{outbox}' to '{name}'",
            "ManageWalSlot": "{action} WAL slot for '{name}'",
            "PauseImmediate": "PAUSE IMMEDIATE mode for '{name}'",
            "ResumeImmediate": "RESUME IMMEDIATE mode for '{name}'",
            "WaitForRefresh": "WAIT for '{name}' refresh (deadline {deadline_secs}s)",
            "RunHook": "RUN hook '{hook}'",
        }
        return texts[self.type].format(**a | ({"action": a["action"].upper()} if "action" in a else {}))


@dataclass
class Change:
    symbol: str
    name: str
    kind: str
    cls: str
    description: str


@dataclass
class Summary:
    creates: int = 0
    drops: int = 0
    alters: int = 0
    free: int = 0
    in_place: int = 0
    rebuild: int = 0
    blue_green: int = 0
    destructive: int = 0
    sources: int = 0
    consumers: int = 0
    changes: list[Change] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.creates + self.drops + self.alters + self.sources + self.consumers


@dataclass
class Plan:
    project: str
    from_version: int | None
    to_version: int
    steps: list[Step]
    summary: Summary
    spec_hash: str = ""

    @property
    def empty(self) -> bool:
        return self.summary.total == 0

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, data: dict) -> Plan:
        summary = Summary(**{k: v for k, v in data["summary"].items() if k != "changes"})
        summary.changes = [Change(**c) for c in data["summary"]["changes"]]
        return cls(data["project"], data["from_version"], data["to_version"], [Step(**s) for s in data["steps"]], summary, data.get("spec_hash", ""))

"""Differences between a desired and a live graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Consumer, Name, Node, Source, State
from .dag import dependents
from .shape import normalised


@dataclass
class NodeChange:
    name: Name
    kind: str  # create, drop, unchanged, query, schedule, mode, cdc, metadata
    old: Node | None = None
    new: Node | None = None
    fields: list[str] = field(default_factory=list)


@dataclass
class SourceChange:
    name: Name
    kind: str  # alter
    new: Source
    impact: list[Name] = field(default_factory=list)


@dataclass
class ConsumerChange:
    name: Name
    kind: str  # create, alter, drop
    old: Consumer | None = None
    new: Consumer | None = None


@dataclass
class Diff:
    nodes: list[NodeChange] = field(default_factory=list)
    sources: list[SourceChange] = field(default_factory=list)
    consumers: list[ConsumerChange] = field(default_factory=list)

    @property
    def changes(self) -> list[NodeChange]:
        return [n for n in self.nodes if n.kind != "unchanged"]

    @property
    def empty(self) -> bool:
        return not (self.changes or self.sources or self.consumers)


def compare(old: Node, new: Node) -> NodeChange:
    """A changed query comes with whatever metadata changed beside it."""
    pairs = (("schedule", old.schedule, new.schedule), ("mode", old.mode, new.mode), ("cdc", old.cdc, new.cdc))
    fields = [f for f, a, b in pairs if a != b]
    if normalised(old.query) != normalised(new.query):
        return NodeChange(new.name, "query", old, new, fields)
    kind = "unchanged" if not fields else fields[0] if len(fields) == 1 else "metadata"
    return NodeChange(new.name, kind, old, new, fields)


def diff(desired: State, live: State) -> Diff:
    """Nodes by name, consumers by the name they expose, owned sources by their DDL.

    A changed source rebuilds every node that reads it, directly or through others."""
    out = Diff()
    held, wanted = {o.name: o for o in live.nodes}, {n.name for n in desired.nodes}
    for n in desired.nodes:
        old = held.get(n.name)
        out.nodes.append(compare(old, n) if old else NodeChange(n.name, "create", None, n))
    out.nodes += [NodeChange(o.name, "drop", o) for o in live.nodes if o.name not in wanted]
    for s in desired.sources:
        old = live.source(s.name)
        if s.owned and (old is None or normalised(old.ddl) != normalised(s.ddl)):
            out.sources.append(SourceChange(s.name, "alter", s, [n for n in dependents(desired, [s.name]) if live.node(n)] if old else []))
    for c in desired.consumers:
        old = live.consumer(c.expose_as)
        if old is None:
            out.consumers.append(ConsumerChange(c.expose_as, "create", None, c))
        elif (old.source, old.body) != (c.source, c.body):
            out.consumers.append(ConsumerChange(c.expose_as, "alter", old, c))
    out.consumers += [ConsumerChange(o.expose_as, "drop", o) for o in live.consumers if desired.consumer(o.expose_as) is None]
    return out


def node_rows(spark: SparkSession, state: State) -> DataFrame:
    rows = [(n.name.schema, n.name.name, normalised(n.query), str(n.mode), n.schedule, n.cdc) for n in state.nodes]
    return spark.createDataFrame(rows, "schema string, name string, query string, mode string, schedule string, cdc string")


def diff_rows(spark: SparkSession, desired: State, live: State) -> DataFrame:
    """The node differences as a full outer join of the two graphs."""
    d, o = node_rows(spark, desired).alias("d"), node_rows(spark, live).alias("o")
    joined = d.join(o, ["schema", "name"], "full_outer")
    differs = lambda c: ~F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}"))
    several = sum((differs(c).cast("int") for c in ("schedule", "mode", "cdc")), F.lit(0))
    kind = F.when(F.col("o.query").isNull(), "create").when(F.col("d.query").isNull(), "drop").when(differs("query"), "query").when(several > 1, "metadata")
    for c in ("schedule", "mode", "cdc"):
        kind = kind.when(differs(c), c)
    return joined.select("schema", "name", kind.otherwise("unchanged").alias("kind"))

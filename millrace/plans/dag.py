"""The graph: building, ordering, levels, subgraphs, diamonds."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from ..errors import CycleError
from ..model import DEFAULT_SCHEDULE, DEFAULT_SCHEMA, Class, Consumer, Mode, Name, Node, Source, State
from ..sources.project import ProjectFile
from .shape import references


def build(spark: SparkSession, files: list[ProjectFile], infer: bool = True) -> State:
    """Desired state of project files; a node depends on what it names and on what its query reads."""
    out = State()
    for f in files:
        schema = f.get("schema", DEFAULT_SCHEMA)
        if f.kind == "stream":
            explicit = [Name.parse(d) for d in f.get("depends_on", [])]
            found = references(spark, f.sql) if infer else []
            own = Name(schema, f.stem)
            depends = [*explicit, *(n for n in found if n not in explicit)]
            out.nodes.append(Node(own, f.sql, Mode.parse(f.get("refresh_mode", "DIFFERENTIAL")), f.get("schedule", DEFAULT_SCHEDULE), f.get("cdc_mode"), depends, explicit))
        elif f.kind == "source":
            out.sources.append(Source(Name(schema, f.stem), f.get("owned", False), f.sql))
        else:
            expose = Name.parse(f.get("expose_as", f"{schema}.{f.stem}"))
            out.consumers.append(Consumer(Name(schema, f.stem), Name.parse(f.get("source", f.stem)), expose, f.sql))
    return out


def infer(spark: SparkSession, state: State) -> State:
    """The state with dependencies read from the queries where none are recorded."""
    for n in state.nodes:
        if not n.depends_on:
            n.depends_on = references(spark, n.query)
    return state


def topological(state: State) -> list[Name]:
    """Kahn's order, ties as declared; edges from sources do not count."""
    own = [n.name for n in state.nodes]
    known = set(own)
    waits = {n.name: {d for d in n.depends_on if d in known} for n in state.nodes}
    after: dict[Name, list[Name]] = {}
    for n in own:
        for d in waits[n]:
            after.setdefault(d, []).append(n)
    left = {n: len(waits[n]) for n in own}
    ready, out = deque(n for n in own if not left[n]), []
    while ready:
        n = ready.popleft()
        out.append(n)
        for m in after.get(n, []):
            left[m] -= 1
            if not left[m]:
                ready.append(m)
    if len(out) < len(own):
        raise CycleError(", ".join(str(n) for n in own if left[n]))
    return out


def dependents(state: State, roots: list[Name], transitive: bool = True) -> list[Name]:
    """Nodes that read any of the roots, directly or through others, in topological order."""
    found, todo = set(), list(roots)
    while todo:
        r = todo.pop()
        for n in state.nodes:
            if r in n.depends_on and n.name not in found:
                found.add(n.name)
                if transitive:
                    todo.append(n.name)
    return [n for n in topological(state) if n in found]


def ancestors(state: State, name: Name) -> set[Name]:
    """Nodes that a node reads, directly or through others."""
    by_name = {n.name: n for n in state.nodes}
    found, todo = set(), [name]
    while todo:
        for d in by_name[todo.pop()].depends_on:
            if d in by_name and d not in found:
                found.add(d)
                todo.append(d)
    return found


def subgraph(state: State, anchor: Name) -> set[Name]:
    """The anchor, its descendants and its own ancestors; empty if it is unknown."""
    if state.node(anchor) is None:
        return set()
    return {anchor, *dependents(state, [anchor]), *ancestors(state, anchor)}


def promote_diamonds(state: State, classes: dict[Name, Class]) -> dict[Name, Class]:
    """Where two or more changed parents meet, the node and its changed ancestors get the group's highest class."""
    out = dict(classes)
    for name in topological(state):
        node = state.node(name)
        if name not in classes or sum(d in classes for d in set(node.depends_on)) < 2:
            continue
        group = [name, *(a for a in ancestors(state, name) if a in classes)]
        top = max(out[g] for g in group)
        for g in group:
            out[g] = top
    return out


def edges(spark: SparkSession, state: State) -> DataFrame:
    rows = [(str(d), str(n.name)) for n in state.nodes for d in n.depends_on]
    return spark.createDataFrame(rows, "src string, dst string")


def levels(spark: SparkSession, state: State) -> DataFrame:
    """Depth of every node: 0 for nodes that read sources only, else one more than the deepest node that it reads."""
    depth: dict[Name, int] = {}
    for name in topological(state):
        depth[name] = max((depth[d] + 1 for d in state.node(name).depends_on if d in depth), default=0)
    return spark.createDataFrame([(str(n), d) for n, d in depth.items()], "name string, depth int")

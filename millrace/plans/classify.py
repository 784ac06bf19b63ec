"""What a change costs: free, in place, or a rebuild."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import SqlParseError
from ..model import Class, Mode
from .diff import NodeChange
from .shape import Shape, shape


def _loses_history(change: NodeChange) -> bool:
    return change.old is not None and change.new is not None and change.old.mode == Mode.FULL and change.new.mode == Mode.DIFFERENTIAL


def columns_change(old: Shape, new: Shape) -> str:
    """same, added, removed (at the end), renamed or other."""
    a, b = [(i.text, i.alias) for i in old.items], [(i.text, i.alias) for i in new.items]
    if a == b:
        return "same"
    if len(b) > len(a) and b[: len(a)] == a:
        return "added"
    if 0 < len(b) < len(a) and a[: len(b)] == b:
        return "removed"
    return "renamed" if [t for t, _ in a] == [t for t, _ in b] else "other"


def classify_query(spark: SparkSession, old: str, new: str) -> Class:
    """In place if only columns at the end came or went and every other clause is the same."""
    try:
        x, y = shape(spark, old), shape(spark, new)
    except SqlParseError:
        return Class.REBUILD
    if x.command or y.command or x.set_op or y.set_op or x.clauses != y.clauses or x.grouped != y.grouped:
        return Class.REBUILD
    return {"same": Class.FREE, "added": Class.IN_PLACE, "removed": Class.IN_PLACE}.get(columns_change(x, y), Class.REBUILD)


def classify(spark: SparkSession, change: NodeChange) -> Class:
    if change.kind in ("create", "drop"):
        return Class.REBUILD
    if change.kind == "unchanged":
        return Class.FREE
    if _loses_history(change):
        return Class.REBUILD
    if change.kind == "query":
        if change.old is None or change.new is None:
            return Class.REBUILD
        found = classify_query(spark, change.old.query, change.new.query)
        # the same columns in another wording: nothing proves that the rows are the same
        return Class.REBUILD if found == Class.FREE else found
    return Class.FREE

"""Estimates of rows and time for each step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..model import Plan

ROW_BYTES, BYTES_PER_SECOND = 200, 50 * 1024 * 1024


@dataclass
class StepCost:
    step: str
    rows: int | None
    duration: str
    cls: str


def duration_text(rows: int | None, row_bytes: int = ROW_BYTES, throughput: int = BYTES_PER_SECOND) -> str:
    if rows is None:
        return "—"
    secs = max(rows, 0) * row_bytes // throughput
    if not secs:
        return "< 1s"
    for unit, size in (("h", 3600), ("m", 60)):
        if secs >= size:
            return f"~{secs // size}{unit}"
    return f"~{secs}s"


def estimated_rows(spark: SparkSession, df) -> int | None:
    """Catalyst's row count, or its size over a row's usual size; None for a plan without statistics."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    size = int(str(stats.sizeInBytes()))
    return None if size >= 1 << 62 else size // ROW_BYTES


def plan_cost(plan: Plan, rows_of) -> list[StepCost]:
    """rows_of(name, query) estimates what a backfill writes; None where it cannot."""
    queries = {s.args["name"]: s.args.get("query") or s.args.get("spec", {}).get("query") for s in plan.steps if s.type in ("CreateStreamTable", "AlterStreamTable", "CreateStreamTableInGreen")}
    out = []
    for s in plan.steps:
        rows = None
        if s.type in ("Backfill", "CreateStreamTableInGreen") and queries.get(s.args["name"]):
            rows = rows_of(s.args["name"], queries[s.args["name"]])
        cls = {"CreateStreamTable": "rebuild", "DropStreamTable": "rebuild", "CreateStreamTableInGreen": "blue-green"}.get(s.type, "free")
        if s.type == "Backfill":
            cls = "in-place" if s.args["mode"] == "INCREMENTAL" else "rebuild"
        out.append(StepCost(s.describe(), rows, duration_text(rows), cls))
    return out


def total_hint(costs: list[StepCost]) -> str:
    heavy = {c.cls for c in costs if c.rows}
    return "minutes (rebuild)" if heavy & {"rebuild", "blue-green"} else "seconds (in-place backfill)" if "in-place" in heavy else "< 1s"

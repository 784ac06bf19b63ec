"""Structured Streaming into a source, refreshing what depends on it after every batch."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame

from ..model import Name
from ..operators.project import Project
from ..plans.dag import dependents
from ..sources.config import seconds


def follow(project: Project, stream: DataFrame, source: str, checkpoint: str, schedule: str | None = None, available_now: bool = False):
    """Appends each micro-batch to the source once, then refreshes its dependents; returns the query.

    A batch that was stored before a failure is not stored again: the number of a stream's last batch is part of the
    record that makes its rows visible. A stream is named by its checkpoint, so several may feed one source."""
    name, own = Name.parse(source), md5(checkpoint.rstrip("/").encode()).hexdigest()

    def take(batch: DataFrame, number: int) -> None:
        if number > project.tables.batch(name, own):
            if project.tables.version(name):
                project.tables.change(name, batch, None, batch=(own, number))
            else:
                project.tables.put(name, batch, (own, number))
        live = project.live()
        reached = [str(n) for n in dependents(live, [name])]
        if reached:
            project.refresh(reached)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif schedule:
        writer = writer.trigger(processingTime=f"{seconds(schedule) or 30} seconds")
    return writer.start()

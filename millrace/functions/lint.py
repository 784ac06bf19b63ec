"""Advice on project files."""

from __future__ import annotations

from pathlib import Path

from ..errors import IvmUnsupportable, SqlParseError
from ..model import Name, State
from ..plans.shape import check_ivm, shape
from ..sources.config import seconds
from ..sources.project import ProjectFile
from .validate import Diagnostic


def check(spark, files: list[ProjectFile], state: State) -> list[Diagnostic]:
    """One diagnostic, with code L:<rule>, for each rule that a file breaks."""
    out: list[Diagnostic] = []

    def say(severity, rule, f, message):
        out.append(Diagnostic(severity, f"L:{rule}", f"'{f.stem}': {message}", f.path))

    nodes = {n.name for n in state.nodes} | {s.name for s in state.sources}
    for f in files:
        if f.get("cypher_source") and not (Path(f.path).parent / f.get("cypher_source")).exists():
            say("error", "cypher-source-missing", f, f"{f.get('cypher_source')} does not exist")
        if f.kind == "consumer":
            source = Name.parse(f.get("source", f.stem))
            if source not in nodes and source.name not in {n.name for n in nodes}:
                say("error", "consumer-source-not-found", f, f"reads {source}, which the project does not have")
        if f.kind != "stream":
            continue
        every = seconds(f.get("schedule", ""))
        if every is not None and every < 5:
            say("warning", "schedule-too-aggressive", f, f"refreshes every {every} s")
        if f.get("refresh_mode") == "FULL":
            try:
                s = shape(spark, f.sql)
                if not {"where", "globallimit", "locallimit"} & set(s.clauses):
                    say("warning", "full-refresh-no-filter", f, "every refresh reads all rows: no WHERE or LIMIT")
            except SqlParseError:
                pass
            say("warning", "rebuild-may-affect-rls", f, "a rebuild drops and recreates the table with its row policies")
        elif f.get("refresh_mode", "DIFFERENTIAL") == "DIFFERENTIAL":
            try:
                check_ivm(spark, f.sql, f.stem)
            except IvmUnsupportable as e:
                say("warning", "differential-ivm-unsupportable", f, f"cannot be maintained from changes: {e}")
            except SqlParseError:
                pass
    return out

"""Diagnostics of project files and graphs."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import CycleError, IvmUnsupportable, SqlParseError
from ..model import State
from ..plans.dag import topological
from ..plans.shape import check_consumer, check_ivm, check_query
from ..sources.project import ProjectFile


@dataclass
class Diagnostic:
    severity: str
    code: str
    message: str
    file: str = ""
    line: int | None = None
    column: int | None = None
    hint: str = ""

    def render(self) -> str:
        place = ":".join(str(p) for p in (self.file, self.line, self.column) if p)
        return (f"{place}: " if place else "") + f"{self.severity}[{self.code}]: {self.message}" + (f"\n  hint: {self.hint}" if self.hint else "")


def check(spark, files: list[ProjectFile], state: State) -> list[Diagnostic]:
    """E101 syntax, E102 not maintainable from changes (by the effective mode), E201 cycle, E202 consumer body, W001 unknown directive."""
    out = []
    for f in files:
        out += [Diagnostic("warning", "W001", f"unknown directive '{k}'", f.path, hint="it may be meant for a newer version") for k in f.unknown]
        if f.kind == "source" or not f.sql:
            continue
        try:
            if f.kind == "consumer":
                check_consumer(spark, f.sql, f.stem)
            elif f.get("refresh_mode", "DIFFERENTIAL") == "DIFFERENTIAL":
                check_ivm(spark, f.sql, f.stem)
            else:
                check_query(spark, f.sql, f.stem)
        except SqlParseError as e:
            out.append(Diagnostic("error", "E101", str(e), f.path, hint="check the syntax of the query"))
        except IvmUnsupportable as e:
            out.append(Diagnostic("error", "E102", str(e), f.path, hint="use FULL refresh mode, or write the query without it"))
        except Exception as e:
            out.append(Diagnostic("error", "E202", str(e), f.path))
    try:
        topological(state)
    except CycleError as e:
        out.append(Diagnostic("error", "E201", f"dependency cycle: {e}"))
    return out

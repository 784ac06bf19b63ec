"""Project files: SQL with directives in leading comments."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import ParseError
from ..model import Mode
from .config import substitute_vars

KINDS = ("stream", "source", "consumer")
_DIRECTIVE = re.compile(r"^--\s*@\w+:(\w+)\s*=\s*(.*?)\s*$")
#: Spellings of the change-capture modes.
CDC = {"trigger": "trigger", "row": "trigger", "statement": "trigger", "wal": "wal", "none": "none", "disabled": "none", "outbox": "outbox"}
KEYS = ("kind", "owned", "schema", "depends_on", "schedule", "refresh_mode", "cdc_mode", "cypher_source", "source", "expose_as")


@dataclass
class ProjectFile:
    path: str
    sql: str = ""
    kind: str = "stream"
    directives: dict = field(default_factory=dict)
    unknown: dict[str, str] = field(default_factory=dict)

    @property
    def stem(self) -> str:
        return Path(self.path).stem

    def get(self, key: str, default=None):
        return self.directives.get(key, default)


def load(directory: str | Path, values: dict[str, str] | None = None) -> list[ProjectFile]:
    """migrations/streams, sources and consumers, each by path, subfolders too; a missing folder is skipped."""
    found = []
    for part in ("streams", "sources", "consumers"):
        folder = Path(directory) / "migrations" / part
        if folder.is_dir():
            found += [parse(str(p), p.read_text(), values) for p in sorted(folder.rglob("*.sql"))]
    return found


def parse(path: str, text: str, values: dict[str, str] | None = None) -> ProjectFile:
    """Leading comments hold directives; variables are replaced there only; the rest is the body without a final semicolon."""
    lines = text.splitlines()
    out = ProjectFile(path)
    at = 0
    while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("--")):
        m = _DIRECTIVE.match(lines[at].strip())
        if m:
            _directive(out, m[1], substitute_vars(m[2], values or {}))
        at += 1
    out.sql = "\n".join(lines[at:]).strip().rstrip(";").rstrip()
    return out


def _directive(out: ProjectFile, key: str, raw: str) -> None:
    value = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] == '"' else raw
    fail = lambda why: ParseError(f"{out.path}: {key}: {why}")
    if key not in KEYS:
        out.unknown[key] = raw
    elif key == "kind":
        if value not in KINDS:
            raise fail(f"unknown kind '{value}'")
        out.kind = value
    elif key == "owned":
        if value not in ("true", "false"):
            raise fail("true or false expected")
        out.directives[key] = value == "true"
    elif key == "depends_on":
        try:
            names = json.loads(raw)
        except ValueError as e:
            raise fail(str(e)) from e
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise fail("a list of names expected")
        out.directives[key] = names
    elif key == "cdc_mode":
        if value.lower() not in CDC:
            raise fail(f"unknown mode '{value}'")
        out.directives[key] = CDC[value.lower()]
    elif key == "refresh_mode":
        out.directives[key] = str(Mode.parse(value))
    else:
        out.directives[key] = value

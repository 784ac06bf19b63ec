"""Canonical form of project files."""

from __future__ import annotations

import json

from ..plans.shape import tokens
from ..sources.project import KEYS, ProjectFile

MARK = "millrace"
#: Words that the canonical form writes in capitals.
KEYWORDS = frozenset(
    """
    select from where group by order having join inner left right outer full cross on as and or not in is null like
    between case when then else end distinct all union intersect except insert update delete into values set create
    alter drop table view index unique primary key foreign references default constraint with sum count min max avg
    coalesce nullif cast over partition window rows range preceding following unbounded current row row_number rank
    dense_rank lag lead first_value last_value limit offset using
    """.split()
)


def keywords(sql: str) -> str:
    """Keywords in capitals outside literals and comments; no blanks at line ends."""
    text = "".join(t.upper() if t.lower() in KEYWORDS else t for t in tokens(sql))
    return "\n".join(line.rstrip() for line in text.splitlines()).strip()


def render(f: ProjectFile) -> str:
    """Directives in a fixed order (defaults left out), unknown ones by name, an empty line, the body, one line end."""
    given = dict(f.directives)
    if f.kind != "stream":
        given["kind"] = f.kind
    if given.get("schema") == "public":
        del given["schema"]
    lines = []
    for key in KEYS:
        value = given.get(key)
        if value in (None, []):
            continue
        text = json.dumps(value) if isinstance(value, list | bool) else f'"{value}"'
        lines.append(f"-- @{MARK}:{key} = {text}")
    lines += [f"-- @{MARK}:{k} = {f.unknown[k]}" for k in sorted(f.unknown)]
    body = keywords(f.sql) if f.sql else ""
    return "\n".join([*lines, *([""] if lines and body else []), *([body] if body else [])]) + "\n"

"""Project files from a dbt target folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import JsonError
from ..functions.fmt import render
from .project import ProjectFile


@dataclass
class Ingested:
    written: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)

    @property
    def changed(self) -> bool:
        return bool(self.written)


def _compiled(target: Path, node: dict) -> str | None:
    """Compiled SQL: inline, by its path (below the target or its parent), else the first file of that name."""
    if node.get("compiled_code") or node.get("compiled_sql"):
        return node.get("compiled_code") or node["compiled_sql"]
    path = node.get("compiled_path") or ""
    for base in (Path("."), target, target.parent):
        if path and (base / path).is_file():
            return (base / path).read_text()
    return next((p.read_text() for p in sorted((target / "compiled").rglob(f"{node['name']}.sql"))), None)


def dependencies(node: dict, sources: dict) -> list[str]:
    """The node's own list, else the sources it refers to, as schema.identifier."""
    own = node.get("config", {}).get("depends_on") or node.get("config", {}).get("meta", {}).get("depends_on")
    if own:
        return list(own)
    refs = [sources[u] for u in node.get("depends_on", {}).get("nodes", []) if u in sources]
    return sorted({f"{s['schema']}.{s.get('identifier') or s['name']}" for s in refs})


def ingest(target: str | Path, out: str | Path) -> Ingested:
    """Stream files of models materialized as stream_table and files of their sources, written only where they differ."""
    target, out = Path(target), Path(out)
    try:
        manifest = json.loads((target / "manifest.json").read_text())
    except (OSError, ValueError) as e:
        raise JsonError(f"no readable manifest in {target}: {e}") from e
    sources, result = manifest.get("sources", {}), Ingested()

    def put(folder: str, f: ProjectFile) -> None:
        path = out / "migrations" / folder / f"{f.path}.sql"
        path.parent.mkdir(parents=True, exist_ok=True)
        text = render(f)
        same = path.exists() and path.read_text() == text
        (result.unchanged if same else result.written).append(str(path))
        if not same:
            path.write_text(text)

    models = [n for n in manifest.get("nodes", {}).values() if n.get("resource_type") == "model" and n.get("config", {}).get("materialized") == "stream_table"]
    for node in sorted(models, key=lambda n: n["name"]):
        sql = _compiled(target, node)
        if sql is None:
            result.missing.append(node["name"])
            continue
        c = node["config"]
        d = {k: c[k] for k in ("schedule", "cdc_mode") if c.get(k)} | {"refresh_mode": (c.get("refresh_mode") or "DIFFERENTIAL").upper(), "depends_on": dependencies(node, sources)}
        if node.get("schema"):
            d["schema"] = node["schema"]
        put("streams", ProjectFile(node["name"], sql.strip().rstrip(";"), "stream", d))
    used = {d for n in models for d in dependencies(n, sources)}
    for s in sorted(sources.values(), key=lambda s: s["name"]):
        name = s.get("identifier") or s["name"]
        if f"{s['schema']}.{name}" in used:
            put("sources", ProjectFile(name, "", "source", {"owned": False, "schema": s["schema"]}))
    return result

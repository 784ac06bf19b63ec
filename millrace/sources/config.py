"""Project configuration, maintenance windows, schedules and other small settings."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from ..errors import ConfigError, MissingVariable, PlaintextPassword, TomlError


@dataclass
class Target:
    warehouse: str = ""
    vars: dict[str, str] = field(default_factory=dict)


@dataclass
class ApplySettings:
    lock_timeout: str = "30s"
    maintenance_window: str | None = None
    allow_full_refresh: bool = False
    default_strategy: str = "default"
    applies_to: tuple[str, ...] = ("rebuild", "blue-green")
    pre_hooks: list[str] = field(default_factory=list)
    post_hooks: list[str] = field(default_factory=list)


@dataclass
class Config:
    project: str
    catalog_schema: str = "catalog"
    targets: dict[str, Target] = field(default_factory=dict)
    apply: ApplySettings = field(default_factory=ApplySettings)

    def target(self, name: str) -> Target:
        if name not in self.targets:
            raise ConfigError(f"no target '{name}'; known targets: {', '.join(sorted(self.targets)) or 'none'}")
        return self.targets[name]

    @classmethod
    def parse(cls, text: str) -> Config:
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise TomlError(str(e)) from e
        if "name" not in data.get("project", {}):
            raise ConfigError("[project] needs a name")
        targets = {n: Target(resolve_env(t.get("warehouse", t.get("dsn", ""))), {k: str(v) for k, v in t.get("vars", {}).items()}) for n, t in data.get("targets", {}).items()}
        a = data.get("apply", {})
        hooks = a.get("hooks", {})
        listed = lambda h: [h] if isinstance(h, str) else list(h)
        applies = a.get("maintenance_window_applies_to", ["rebuild", "blue-green"])
        settings = ApplySettings(a.get("lock_timeout", "30s"), a.get("maintenance_window"), bool(a.get("allow_full_refresh", False)), a.get("default_strategy", "default"), tuple(listed(applies)), listed(hooks.get("pre", [])), listed(hooks.get("post", [])))
        return cls(data["project"]["name"], catalog_name(data["project"].get("catalog_schema", "catalog")), targets, settings)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        try:
            return cls.parse(Path(path).read_text())
        except OSError as e:
            raise ConfigError(f"cannot read {path}: {e}") from e


def resolve_env(text: str) -> str:
    """${NAME} from the environment; a missing one is an error, ${secret:env:KEY} reads KEY."""

    def value(m: re.Match) -> str:
        key = m[1].removeprefix("secret:env:")
        if ":" in key:
            raise ConfigError(f"secret back end of '{m[1]}' is not available")
        if key not in os.environ:
            raise MissingVariable(key)
        return os.environ[key]

    return re.sub(r"\$\{([^}]+)\}", value, text)


def substitute_vars(text: str, values: dict[str, str]) -> str:
    """{{ var.NAME }} from the environment variable MILLRACE_VAR_NAME, else from `values`."""

    def value(m: re.Match) -> str:
        name = m[1]
        found = os.environ.get(f"MILLRACE_VAR_{name}", os.environ.get(f"MILLRACE_VAR_{name.upper()}", values.get(name)))
        if found is None:
            raise MissingVariable(name)
        return found

    return re.sub(r"\{\{\s*var\.(\w+)\s*\}\}", value, text)


def seconds(schedule: str) -> int | None:
    """Ns, Nm, Nh, Nd or a bare number of seconds; anything else is no interval."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", schedule or "")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else None


def _offset(zone: str) -> int:
    """Minutes east of UTC; 0 for UTC, Z and zones that are not an offset."""
    m = re.fullmatch(r"(?:UTC)?([+-])(\d{1,2}):(\d{2})", zone.strip())
    return (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1) if m else 0


def in_window(window: str | None, now: datetime) -> bool:
    """Whether a UTC time is in HH:MM-HH:MM [zone]: end exclusive, may wrap midnight; no or no valid window allows all."""
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})-(\d{1,2}):(\d{2})(?:\s+(.*?))?\s*", window or "")
    if not m:
        return True
    local = now + timedelta(minutes=_offset(m[5] or ""))
    at, start, end = local.hour * 60 + local.minute, int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    return start <= at < end if start <= end else at >= start or at < end


def check_password(dsn: str, allow: bool = False) -> None:
    """Refuses URL and key=value connection strings with a password in plain text."""
    if not allow and (re.search(r"://[^/@:]+:[^/@]+@", dsn) or re.search(r"(?i)(?:^|\s)password\s*=\s*\S", dsn)):
        raise PlaintextPassword("plain-text password in connection string")


#: Names that a catalog schema may not have.
RESERVED = ("public", "information_schema", "pg_catalog", "pg_toast")


def catalog_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or name.startswith("pg_") or name in RESERVED:
        raise ConfigError(f"'{name}' is no valid catalog schema")
    return name

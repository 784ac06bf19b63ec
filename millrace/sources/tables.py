"""Versioned tables: immutable Parquet folders and one small record that points at them.

Every version says which folders hold its rows and, if it came from its predecessor by known changes, where the added and
removed rows are.  A node's version also names the versions of its inputs and the folders of its hidden state, so that
result, state and progress become visible by one atomic replacement of one record, or not at all.

Contents are a list of folders or are dealt out by the hash of keys into buckets, a folder each; a refresh writes the
buckets that it touches and its version points at those of earlier versions for the rest.  An append adds a folder and
copies nothing.  A source attached to a folder keeps a log of the files it has taken in; new files become added rows.

A commit claims the next version by creating a file that must not exist yet, reads the record again and replaces it; who
loses the claim starts from the new record, so no commit undoes another.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

from ..errors import StorageError
from ..model import Name
from .storage import Files, Records

KEPT = 20
#: Seconds after which a claim counts as left behind by a failed process.
LEASE = 60.0
#: Bytes of input for each bucket of a node's state, and how many buckets there are at least and at most.
BUCKET_BYTES, FEWEST, MOST = 64 << 20, 4, 2048
#: A table of more folders than this is merged into one.
FOLDERS = 64
BUCKET, _SHARE = "mr_bucket", "mr_share"
#: Tasks that write one bucket, before Spark joins those that have little and splits those that have much.
SHARES = 8
_PLAIN = (NumericType, StringType, DateType, TimestampType)


class Conflict(StorageError):
    """The table has moved on from the version that a change was computed for."""


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files.at(spark, root)
        self.records = Records(self.files)
        self.written = lambda path: None  # tests make writes fail here

    # folders

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.files.root}/data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written(path)
        return path

    def plain(self, name: Name | str, df: DataFrame) -> dict:
        """Contents written as one folder."""
        return {"paths": [self._write(str(name), df)], "schema": _ddl(df)}

    def bucketed(self, name: Name | str, df: DataFrame, keys: list[str], n: int, base: dict | None = None, touched: list[int] | None = None) -> dict:
        """Contents dealt out by keys; with `base`, its buckets but for the touched ones, which df replaces.

        Several tasks write a bucket that is large, by the hash of its rows and beyond that by size, so that no key's rows
        need one task; small buckets share one."""
        path = f"{self.files.root}/data/{name}/{uuid.uuid4().hex}"
        dealt = df.withColumn(BUCKET, bucket_of(keys, n))
        plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, _PLAIN)]
        share = F.pmod(F.xxhash64(F.lit(1), *plain), F.lit(SHARES))
        dealt = dealt.withColumn(_SHARE, F.col(BUCKET) * SHARES + share).hint("rebalance", SHARES * (n if touched is None else max(1, len(touched))), _SHARE)
        dealt.drop(_SHARE).write.partitionBy(BUCKET).parquet(path)
        self.written(path)
        there = {int(f.split("=")[1]) for f in self.files.names(path.removeprefix(f"{self.files.root}/")) if f.startswith(f"{BUCKET}=")}
        folders, at = (list(base["folders"]), list(base["at"])) if base else ([], [-1] * n)
        folders.append(path)
        for b in range(n) if touched is None else touched:
            at[b] = len(folders) - 1 if b in there else -1
        used = sorted({a for a in at if a >= 0})
        return {"folders": [folders[a] for a in used], "at": [used.index(a) if a >= 0 else -1 for a in at], "keys": keys, "schema": _ddl(df)}

    def buckets_for(self, size: int) -> int:
        return max(FEWEST, min(MOST, -(-size // BUCKET_BYTES)))

    def bytes_of(self, contents: dict) -> int:
        return sum(self.files.size(p) for p in _folders(contents, self._log))

    def frame(self, contents: dict, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame:
        """Rows of contents, or of some of its buckets."""
        return self._read(self._paths(contents, buckets), schema or contents["schema"])

    def _paths(self, contents: dict, buckets: list[int] | None = None) -> list[str]:
        if "at" in contents:
            at = contents["at"]
            return [f"{contents['folders'][at[b]]}/{BUCKET}={b}" for b in (range(len(at)) if buckets is None else buckets) if at[b] >= 0]
        return _folders(contents, self._log)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # records

    def record(self, name: Name | str) -> dict | None:
        return self.records.get("tables", str(name))

    def version(self, name: Name | str) -> int:
        r = self.record(name)
        return r["version"] if r else 0

    def entry(self, name: Name | str, version: int | None = None) -> dict | None:
        """What the record says of a version; None if there is none."""
        r = self.record(name)
        return r["versions"].get(str(version or r["version"])) if r else None

    def known(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names("tables")]

    def put(self, name: Name | str, df: DataFrame, batch: tuple[str, int] | None = None, **more) -> int:
        """A new version with new contents, without known changes."""
        entry = self.plain(name, df) | {"full": True} | more
        return self._commit(str(name), lambda r: entry, batch)

    def commit(self, name: Name | str, since: int, entry: dict) -> int:
        """A new version with an entry that was computed for version `since`; a Conflict if that is no longer the newest."""

        def checked(r: dict) -> dict:
            if r["version"] != since:
                raise Conflict(f"{name} is at version {r['version']}, not {since}")
            return entry

        return self._commit(str(name), checked)

    def change(self, name: Name | str, plus: DataFrame | None, minus: DataFrame | None, batch: tuple[str, int] | None = None) -> int:
        """A new version from the last one by added and removed rows (as bags).

        Without removed rows the added folder joins the old ones; else the contents are written anew, the old rows less the
        removed and with the added ones. `batch` (stream, number) goes on record with the version, and a batch that is on
        record already adds nothing."""
        key = str(name)
        if self.record(key) is None:
            raise StorageError(f"no table {key}")
        added = [self._write(key, plus)] if plus is not None else []
        removed = [self._write(key, minus)] if minus is not None else []
        changed = self.changer(key, added, removed)
        return self._commit(key, lambda r: changed(r["versions"][str(r["version"])], r["schema"]), batch)

    def changer(self, key: str, added: list[str], removed: list[str]) -> Callable[[dict, str], dict]:
        """Gives the entry after a change of an entry; contents that must be written are written once an entry."""
        written: dict[str, dict] = {}

        def after(old: dict, schema: str) -> dict:
            if not removed:
                return {k: old[k] for k in ("log",) if k in old} | {"paths": old.get("paths", []) + added, "schema": schema, "plus": added, "minus": [], "full": False}
            at = repr(self._paths(old))
            if at not in written:
                now = self.frame(old, schema=schema).exceptAll(self._read(removed, schema))
                now = now.unionByName(self._read(added, schema)) if added else now
                written[at] = self.plain(key, now)
            return written[at] | {"schema": schema, "plus": added, "minus": removed, "full": False}

        return after

    def batch(self, name: Name | str, stream: str) -> int:
        """The last batch of a stream that the table has, -1 if none."""
        return ((self.record(name) or {}).get("streams") or {}).get(stream, -1)

    def _commit(self, key: str, entry: Callable[[dict], dict | None], batch: tuple[str, int] | None = None, source: dict | None = None) -> int:
        """entry gives the new version's entry from the record that the commit starts from; None leaves it as it is."""
        while True:
            r = self.record(key) or {"version": 0, "versions": {}}
            if batch and r.get("streams", {}).get(batch[0], -1) >= batch[1]:
                return r["version"]
            new = entry(r)
            if new is None:
                return r["version"]
            v, claim, token = r["version"] + 1, f"{key}-{r['version'] + 1}", uuid.uuid4().hex
            if not self.records.insert("claims", claim, {"at": time.time(), "token": token}):
                held = self.records.get("claims", claim)
                if held and held["at"] + LEASE < time.time() and (self.record(key) or {"version": 0})["version"] < v:
                    self.records.remove("claims", claim)
                time.sleep(0.05)
                continue
            try:
                if (self.record(key) or {"version": 0})["version"] != v - 1:
                    continue
                r["version"], r["schema"], r["versions"][str(v)] = v, new["schema"], new
                if batch:
                    r.setdefault("streams", {})[batch[0]] = batch[1]
                if source:
                    r["source"] = source
                for old in sorted(map(int, r["versions"]))[:-KEPT]:
                    del r["versions"][str(old)]
                if (self.records.get("claims", claim) or {}).get("token") != token:
                    continue  # it slept longer than its lease, and another has the claim
                self.records.put("tables", key, r)
                return v
            finally:
                if (self.records.get("claims", claim) or {}).get("token") == token:
                    self.records.remove("claims", claim)

    def swap(self, name: Name | str, entry: dict) -> int:
        """A new version with another table's entry."""
        return self._commit(str(name), lambda r: entry)

    def restore(self, name: Name | str, version: int) -> None:
        """Makes an older version's contents the newest version."""

        def again(r: dict) -> dict:
            old = r["versions"].get(str(version))
            if old is None:
                raise StorageError(f"version {version} is gone")
            return {k: v for k, v in old.items() if k not in ("plus", "minus", "touched")} | {"full": True}

        self._commit(str(name), again)

    def read(self, name: Name | str, version: int | None = None) -> DataFrame:
        r = self.record(name)
        if r is None:
            raise StorageError(f"no table {name}")
        held = r["versions"].get(str(version or r["version"]))
        if held is None:
            raise StorageError(f"version {version} is gone")
        return self.frame(held)

    def changes(self, name: Name | str, since: int, upto: int | None = None) -> tuple[DataFrame | None, DataFrame | None] | None:
        """Rows added and removed from one version to another; None if that is not known. Rows that came and went cancel out.

        Where versions say which buckets they touched, the difference of those buckets is the change."""
        r = self.record(name)
        upto = upto or r["version"]
        steps = [r["versions"].get(str(v)) for v in range(since + 1, upto + 1)]
        first = r["versions"].get(str(since))
        if first is None or any(s is None or s["full"] for s in steps):
            return None
        if any("touched" in s for s in steps):
            if not all("touched" in s for s in steps) or len(first.get("at", [])) != len(steps[-1]["at"]):
                return None
            touched = sorted({b for s in steps for b in s["touched"]})
            old, new = (self.frame(x, touched) for x in (first, steps[-1]))
            a, b = new.exceptAll(old), old.exceptAll(new)
            return (None if a.isEmpty() else a), (None if b.isEmpty() else b)
        plus, minus = [p for s in steps for p in s["plus"]], [p for s in steps for p in s["minus"]]
        a = self._read(plus, r["schema"]) if plus else None
        b = self._read(minus, r["schema"]) if minus else None
        if a is not None and b is not None and len(steps) > 1:
            a, b = a.exceptAll(b), b.exceptAll(a)
        return a, b

    # sources in files that others write

    def attach(self, name: Name | str, path: str) -> None:
        """A table over existing Parquet files: what is at `path` now is its first version, and sync() takes in what follows."""
        found = self.files.data_files(path)
        if not found:
            raise StorageError(f"no Parquet files at {path}")
        schema = _ddl(self.spark.read.parquet(path))
        log = self._logged(str(name), found)
        self._commit(str(name), lambda r: {"log": log, "paths": [], "schema": schema, "full": True}, source={"path": path, "log": log})

    def sync(self, name: Name | str) -> str:
        """Takes in what has become of an attached folder since the last time: "none", "added" (new files are added rows) or
        "full" (files went or were replaced, so that the table is read anew; rows added or deleted by hand are given up)."""
        r = self.record(name)
        source = (r or {}).get("source")
        if not source:
            return "none"
        seen, found = self._log(source["log"]), self.files.data_files(source["path"])
        if seen == found:
            return "none"
        new = {f: s for f, s in found.items() if f not in seen}
        whole = any(found.get(f) != s for f, s in seen.items())
        log = self._logged(str(name), found)

        def entry(now: dict) -> dict | None:
            if now["source"] != source:
                return None  # another has taken them in
            schema, held = now["schema"], now["versions"][str(now["version"])]
            if whole:
                return {"log": log, "paths": [], "schema": schema, "full": True}
            if held.get("log") == source["log"]:
                return {"log": log, "paths": held["paths"], "schema": schema, "plus": sorted(new), "minus": [], "full": False}
            return held | {"paths": held["paths"] + sorted(new), "plus": sorted(new), "minus": [], "full": False}

        self._commit(str(name), entry, source={"path": source["path"], "log": log})
        return "full" if whole else "added"

    def _logged(self, name: str, files: dict) -> str:
        key = f"{name}/{uuid.uuid4().hex}"
        self.records.put("logs", key, files)
        return key

    def _log(self, key: str) -> dict:
        """Files of a log, which never changes."""
        return self.records.get("logs", key)

    # upkeep

    def merge(self, name: Name | str) -> bool:
        """Writes a table of many folders as one; its rows stay, and so does what is known of earlier changes."""
        r = self.record(name)
        held = r["versions"][str(r["version"])]
        if len(held.get("paths", [])) <= FOLDERS or "log" in held:
            return False
        now = self.plain(name, self.frame(held))
        same = {k: v for k, v in held.items() if k not in ("touched", "at", "folders")} | now
        self.commit(name, r["version"], same | {"schema": held["schema"], "plus": [], "minus": [], "full": False})
        return True

    def drop(self, name: Name | str) -> None:
        """The record goes at once; vacuum removes the files."""
        self.records.remove("tables", str(name))

    def vacuum(self, grace: float = 3600.0) -> int:
        """Removes folders that no version of any table points at; the number removed.

        Younger ones than `grace` seconds stay: a refresh may have written them and not committed yet."""
        used = set()
        for n in self.known():
            for v in self.record(n)["versions"].values():
                for held in (v, *v.get("states", {}).values()):
                    used |= {p.rsplit("/", 1)[-1] for k in ("paths", "folders", "plus", "minus") for p in held.get(k, [])}
        gone = [f"data/{n}/{p}" for n in self.files.names("data") for p in self.files.names(f"data/{n}") if p not in used and self.files.age(f"data/{n}/{p}") >= grace]
        for p in gone:
            self.files.delete(p)
        return len(gone)


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int") if keys else F.lit(0)


def _folders(contents: dict, log) -> list[str]:
    if "at" in contents:
        return contents["folders"]
    return [*(log(contents["log"]) if "log" in contents else ()), *contents.get("paths", [])]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

"""Files of a project on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

from ..errors import IoError


def scratch(spark: SparkSession, label: str = "project") -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise IoError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Files:
    """Small files below a root: whole reads, atomic writes by rename, exclusive creation."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._new_path, self._rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
        self._text = jvm.org.apache.commons.io.IOUtils
        self._conf = conf
        self._fs = self._path("").getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    @staticmethod
    def at(spark: SparkSession, root: str) -> Files | LocalFiles:
        """The files of a root, without a call to the JVM for each where the root is on the driver's own file system."""
        files = Files(spark, root)
        return LocalFiles(files.root, files._path("").toUri().getPath(), files) if files._fs.getScheme() == "file" else files

    def _path(self, name: str):
        return self._new_path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file at once: readers see the old or the new text."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(part, text, True)
        options = SparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE
        try:
            self._context.rename(self._path(part), self._path(name), options)
        except Exception as e:
            raise IoError(f"cannot replace {name}: {e}") from e

    def create(self, name: str, text: str) -> bool:
        """Writes a file only if there is none; False if there is."""
        try:
            self._put(name, text, False)
            return True
        except Exception:
            if self.exists(name):
                return False
            raise

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().endswith((".tmp", ".crc")))

    def age(self, name: str) -> float:
        """Seconds since the last change of a file or folder."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def _at(self, path: str):
        """Any path of Spark's file systems, with its file system."""
        target = self._new_path(path)
        return target.getFileSystem(self._conf), target

    def size(self, path: str) -> int:
        """Bytes below a path."""
        fs, target = self._at(path)
        return fs.getContentSummary(target).getLength()

    def data_files(self, path: str) -> dict[str, list[int]]:
        """Data files at or below a path: their bytes and time of change by name. Hidden and temporary ones do not count."""
        fs, target = self._at(path)
        if not fs.exists(target):
            return {}
        top, found = fs.makeQualified(target).toString(), {}
        listed = fs.listFiles(target, True)
        while listed.hasNext():
            status = listed.next()
            name = status.getPath().toString()
            if not any(p.startswith(("_", ".")) for p in name.removeprefix(top).split("/") if p):
                found[name] = [status.getLen(), status.getModificationTime()]
        return found


class LocalFiles:
    """The same on the driver's own file system."""

    def __init__(self, root: str, folder: str, every: Files | None = None):
        self.root, self._folder, self._every = root, Path(folder), every

    def size(self, path: str) -> int:
        return self._every.size(path)

    def data_files(self, path: str) -> dict[str, list[int]]:
        return self._every.data_files(path)

    def _path(self, name: str) -> Path:
        return self._folder / name

    def exists(self, name: str) -> bool:
        return self._path(name).exists()

    def read(self, name: str) -> str | None:
        try:
            return self._path(name).read_text("utf-8")
        except FileNotFoundError:
            return None

    def write(self, name: str, text: str) -> None:
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        self._put(part, text, "w")
        os.replace(self._path(part), self._path(name))

    def create(self, name: str, text: str) -> bool:
        try:
            self._put(name, text, "x")
            return True
        except FileExistsError:
            return False

    def _put(self, name: str, text: str, mode: str) -> None:
        path = self._path(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, mode, encoding="utf-8") as f:
            f.write(text)

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self._path(folder)) if not n.endswith((".tmp", ".crc")))
        except FileNotFoundError:
            return []

    def age(self, name: str) -> float:
        return time.time() - self._path(name).stat().st_mtime

    def delete(self, name: str) -> bool:
        path = self._path(name)
        try:
            shutil.rmtree(path) if path.is_dir() else path.unlink()
            return True
        except FileNotFoundError:
            return False


class Records:
    """Keyed JSON records, a folder for each kind."""

    def __init__(self, files: Files | LocalFiles):
        self.files = files

    @staticmethod
    def _file(kind: str, key) -> str:
        return f"{kind}/{key:012d}.json" if isinstance(key, int) else f"{kind}/{key}.json"

    def get(self, kind: str, key) -> dict | None:
        text = self.files.read(self._file(kind, key))
        return json.loads(text) if text else None  # a record that is being created reads as none

    def put(self, kind: str, key, value: dict) -> None:
        self.files.write(self._file(kind, key), json.dumps(value, sort_keys=True))

    def insert(self, kind: str, key, value: dict) -> bool:
        return self.files.create(self._file(kind, key), json.dumps(value, sort_keys=True))

    def append(self, kind: str, value: dict) -> int:
        """Stores a record under the next number."""
        names = self.files.names(kind)
        key = int(names[-1].removesuffix(".json")) + 1 if names else 1
        while not self.insert(kind, key, value | {"id": key}):
            key += 1
        return key

    def all(self, kind: str) -> list[dict]:
        return [json.loads(t) for n in self.files.names(kind) if (t := self.files.read(f"{kind}/{n}"))]

    def remove(self, kind: str, key) -> bool:
        return self.files.delete(self._file(kind, key))

"""Small helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_live: dict[str, DataFrame] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes after which a batch for a Python worker is full, in small_batches().
BATCH_BYTES = 8_000_000

#: Bytes of ASCII that are no digit or letter become a space; A-Z become a-z.
_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text: runs of ASCII digits and letters (folded to lower case) and of any non-ASCII bytes."""
    return data.translate(_FOLD).split()


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package as the driver does (clusters use --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_owner: list = []


def working(operator: str, *caches) -> None:
    """Says in a Python worker which operator it works for and which functools caches that fills.

    Workers live on from task to task; when one changes over to another operator, what it held for the last goes and the
    memory goes back to the system, so that a chain of operators needs no more than the largest of them."""
    if _owner and _owner[0] != operator:
        for cache in _owner[1]:
            cache.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library that has no such call frees by itself
            ctypes.CDLL(None).malloc_trim(0)
    _owner[:] = [operator, caches]


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers have about BATCH_BYTES at most; a smaller limit stays.

    Each task holds a batch several times over: in the executor's Arrow buffers, which grow by doubling and stay with
    it for later tasks, and in its Python worker as Arrow and as Python objects."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, on one machine; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: it cuts lineage and survives lost executors.

    The shuffle files of the write go when it is done, as nothing runs df again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    fs, target = _filesystem(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _live[path] = out
    return out


def live() -> list[DataFrame]:
    """Tables of stored() that are still there."""
    return list(_live.values())


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        if _live.pop(df.stored_at, None) is not None:
            fs, target = _filesystem(df.sparkSession, df.stored_at)
            fs.delete(target, True)


def without(keep: list[str], new) -> list[str]:
    """The columns to keep that no new column takes the place of (names compare as Spark compares them)."""
    taken = {n.lower() for n in new}
    return [c for c in keep if c.lower() not in taken]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 when divided by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def digest(data: Column) -> Column:
    """SHA-256 as 32 raw bytes."""
    return F.unhex(F.sha2(data, 256))

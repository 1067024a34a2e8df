"""Tables in the folder that driver and executors share, and what a worker process keeps."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables made in this process: application, path, name in the catalog.
MADE: list[tuple[str, str, str | None]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset on
    a single machine a folder of our own is made, once per application.
    """
    named = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    return worker_cache(("own folder", spark.sparkContext.applicationId), lambda: tempfile.mkdtemp(prefix="vecspark-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    It cuts the lineage: a lost executor costs its running tasks only.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    MADE.append((spark.sparkContext.applicationId, path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in buckets by ``key``, in the shared folder, and read back.

    Joins by ``key`` leave it where it is. The table has a fresh name in the
    session's catalog; there are as many buckets as shuffle partitions, or
    partitions of ``source`` if it has more.
    """
    spark = df.sparkSession
    name = f"vecspark_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/vecspark/{name}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "none").saveAsTable(name)
    MADE.append((spark.sparkContext.applicationId, path, name))
    return spark.table(name)


def forget(spark: SparkSession, first: int, last: int | None = None) -> int:
    """Drop the tables ``MADE[first:last]``, whose readers are done; how many there were."""
    own = MADE[first:last]
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for _, path, name in own:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)
    del MADE[first:last]
    return len(own)


def release(spark: SparkSession) -> int:
    """Drop all tables that :func:`stored` and :func:`bucketed` made for this application; how many there were.

    For when the results that read them are written: a result that is not would
    find its tables gone.
    """
    own = spark.sparkContext.applicationId
    others = [m for m in MADE if m[0] != own]
    MADE[:] = [m for m in MADE if m[0] == own]
    count = forget(spark, 0)
    MADE.extend(others)
    return count


def worker_cache(key: Any, make: Callable[[], Any], keep: int = 8) -> Any:
    """``make()``, kept in this process under ``key``; the oldest of ``keep`` entries goes."""
    holder = sys.modules.setdefault("_vecspark_cache", types.ModuleType("_vecspark_cache"))
    entries = holder.__dict__.setdefault("entries", {})
    if key not in entries:
        while len(entries) >= keep:
            entries.pop(next(iter(entries)))
        entries[key] = make()
    return entries[key]


def given_back() -> None:
    """Give the memory of a worker, which lives on for other tasks, back to the system: what it kept, and what it has free."""
    entries = sys.modules.get("_vecspark_cache", types.ModuleType("_vecspark_cache")).__dict__.get("entries", {})
    for key in [k for k in entries if k[0] != "own folder"]:
        del entries[key]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving the worker's memory back before and after: an executor's idle workers take turns, so each would hold what its last task kept."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_back()
        try:
            yield from run(batches)
        finally:
            given_back()

    return whole

"""The shared scratch folder, tables written there to cut lineage, and what finished work gives back.

Scratch lies below one folder an application, which goes when the driver's
JVM ends; ``released`` drops what a finished block made at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared as folder
from ..shared import hadoop, shared_dir

#: Parquet bytes of a table that may be broadcast; in memory it takes a few times that.
BROADCAST_BYTES = 4 << 20

#: Documents of one Arrow batch; Spark's own 10,000 are tens of MB, several times over in the JVM and in a worker.
BATCH_ROWS = 1024
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Scratch paths and broadcasts of the blocks of ``released`` that are open, innermost last.
_open: list[tuple[list[str], list[Broadcast]]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the application's scratch folder."""
    path = folder.scratch_path(spark, label)
    if _open:
        _open[-1][0].append(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` in this session, unless the application or the session says otherwise."""
    if not spark.sparkContext.getConf().contains(_BATCHES) and spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage but those files, so a lost executor costs no
    recomputation of what came before.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, and the path, for tables that a later one replaces."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    small_batches(spark)
    df.write.parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, label: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written, and marked for broadcast if its files have at most ``most`` bytes; else joins shuffle it."""
    out, path = written_at(df, label)
    fs, at = hadoop(df.sparkSession, path)
    return F.broadcast(out) if fs.getContentSummary(at).getLength() <= most else out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query inside exchanges goes when it ends, not when the driver's JVM next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def shared(spark: SparkSession, value) -> Broadcast:
    """``value`` broadcast; the block of ``released`` that is open destroys it."""
    small_batches(spark)
    out = spark.sparkContext.broadcast(value)
    if _open:
        _open[-1][1].append(out)
    return out


@contextmanager
def released(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Scratch paths (but those in ``keep``) and broadcasts made inside go at the end; what outlives it must not read them."""
    _open.append(([], []))
    try:
        yield
    finally:
        paths, broadcasts = _open.pop()
        for b in broadcasts:
            b.destroy()
        for path in paths:
            if path not in keep:
                drop_path(spark, path)
        trim(spark)


def trim(spark: SparkSession) -> None:
    """Memory that the driver has freed goes back to the machine: Python's, and the JVM's native memory if it has such a command."""
    trim_python()
    app = spark.sparkContext.applicationId
    if app not in _trims:
        _trims.clear()
        _trims[app] = _native_trim(spark)
    _trims[app]()


_trims: dict[str, Callable[[], object]] = {}


def _native_trim(spark: SparkSession) -> Callable[[], object]:
    """What calls the diagnostic command ``System.trim_native_heap``; nothing where the JVM has none."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()}

    def prepared(method: str, *arguments) -> Callable[[], object]:  # the server's own class is hidden; its interface is not
        values = gateway.new_array(jvm.java.lang.Object, len(arguments))
        for k, x in enumerate(arguments):
            values[k] = x
        return lambda: methods[method].invoke(server, values)

    name, command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    if not prepared("isRegistered", name)() or all(o.getName() != command for o in prepared("getMBeanInfo", name)().getOperations()):
        return lambda: None
    return prepared("invoke", name, command, gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))


def trim_python() -> None:
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give:
        give(0)

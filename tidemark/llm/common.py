"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word-based operator: space and 0x09 to 0x0D, which
#: is what ``bytes.split()`` splits on.
SPACES = r"[\x20\x09-\x0D]+"
EVERY = 5  # seconds after which a cut gives back memory as well
_released = time.monotonic()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, which has a row for each key and, as ``size``, the number of rows with it.

    ``size`` is dropped.  Keys with more rows than an average partition would
    have are broadcast, so that their rows stay where they are; there are fewer
    of them than partitions.  The others are shuffled.  Both frames may be read
    more than once and should be cut before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most, least = groups.agg(F.sum(size), F.max(size), F.min(size)).first()
    if not total or most * n <= total:
        return rows.join(groups.drop(size), keys, how)
    if least * n > total:  # fewer than n in all
        return rows.join(F.broadcast(groups.drop(size)), keys, how)
    hot, rest = groups.where(F.col(size) * n > total).drop(size), groups.where(F.col(size) * n <= total).drop(size)
    there = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, how)
    return there.unionByName(others)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there.

    What the driver needs outside of the Java heap grows from plan to plan, so
    that it is given back after any step once ``EVERY`` seconds have gone by.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if time.monotonic() - _released >= EVERY:
        release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more, and give back the driver's own memory.

    Spark's cleaner acts on what the driver's two garbage collectors find;
    between them they may leave the files of finished steps for long.  What the
    driver's Python and its JVM have freed outside of the Java heap (the
    compilers' arenas, buffers) would else stay with their allocators.
    """
    global _released
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # only HotSpot on Linux has it, from 17.0.9 on
        _trim_jvm(spark)
    _released = time.monotonic()


def _trim_jvm(spark: SparkSession) -> None:
    """What ``jcmd PID System.trim_native_heap`` does to the driver's JVM."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    arguments = array(jvm.java.lang.Object, 4)  # no arguments and no signature
    arguments[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    arguments[1] = "systemTrimNativeHeap"
    # by the interface's method, as the server's own class is not open to others
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    next(m for m in methods if m.getName() == "invoke").invoke(server, arguments)


def rows_of(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, so that extra or clashing ones do no harm."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text`` (null stays null)."""
    return rows_of(docs, doc_id=id_col, text=F.col(f"`{text_col}`").cast("binary"))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into consecutive ranges of at most ``limit`` in sum, one item at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a batch's rows and their texts (null: empty), about ``limit`` bytes at a time."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, j in slices(sizes, limit):
        yield i, j, [t or b"" for t in texts.slice(i, j - i).to_pylist()]
    pa.default_memory_pool().release_unused()  # else what one batch took stays with the worker


def only(module) -> None:
    """Called by a worker's step: other modules' tables are given back, as workers go on from query to query."""
    for name, other in list(_TABLES.items()):
        if other is not module:
            other.forget()
            del _TABLES[name]
    if module is not None:
        _TABLES[module.__name__] = module


_TABLES: dict = {}

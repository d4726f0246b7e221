"""Writing lines in order."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .ordering import checkpoint_folder, order_columns


def _checked(path: str) -> str:
    if not path.strip():
        raise ValueError("no path")
    return path


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for intermediate files that all executors see; it goes at the end, also after a failure."""
    path = f"{checkpoint_folder(spark)}/{name}-{os.urandom(6).hex()}"
    try:
        yield path
    finally:
        at, fs = _folder(spark, path)
        fs.delete(at, True)


def write_lines(lines: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    """Part files whose names give the order; no byte order mark, ``\\n`` after each line."""
    lines.select(column).write.mode(mode).text(_checked(path))


def write_runs(runs: DataFrame, path: str, column: str = "value") -> None:
    """One sorted file for each run, in ``path/run_idx=<n>``; ``runs`` are parsed lines with ``run_idx``."""
    dealt = runs.repartition("run_idx").sortWithinPartitions("run_idx", *order_columns())
    dealt.select(column, "run_idx").write.mode("overwrite").partitionBy("run_idx").text(_checked(path))


def write_single_file(lines: DataFrame, path: str, column: str = "value") -> None:
    """One file: part files written beside it and joined by name.

    The joining copies streams through Hadoop's file system, so that the path
    may be in any store that Spark reaches; nothing is held in memory, but all
    bytes go through the driver: for results of a size that one file suits.
    The part files go at the end, also after a failure.
    """
    spark = lines.sparkSession
    parts = f"{_checked(path).rstrip('/')}.{os.urandom(4).hex()}.parts"
    folder, fs = _folder(spark, parts)
    try:
        write_lines(lines, parts, column)
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
        try:
            for name in sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")):
                part = fs.open(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, spark.sparkContext._jsc.hadoopConfiguration(), False)
                finally:
                    part.close()
        finally:
            out.close()
    finally:
        fs.delete(folder, True)

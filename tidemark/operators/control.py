"""Watching a sort and stopping it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.grammar import GRAMMARS, line_bytes
from .parsing import parse_lines


def observed_parse(lines: DataFrame, grammar: str = "strict", name: str = "parse") -> tuple[DataFrame, Observation]:
    """Parsed lines, and counts that are there once an action has run.

    The observation's ``get`` holds ``lines``, ``rejected`` and ``bytes`` of
    what was read; they cost no pass of their own.
    """
    value, seen = F.col("value"), Observation(name)
    rejected = F.count_if(GRAMMARS[grammar][0](value).isNull())
    watched = lines.observe(seen, F.count(F.lit(1)).alias("lines"), rejected.alias("rejected"), F.sum(line_bytes(value)).alias("bytes"))
    return parse_lines(watched, grammar), seen


@contextmanager
def buffered(spark: SparkSession, buffer_bytes: int) -> Iterator[None]:
    """Inside, a task reads at most about ``buffer_bytes`` of a file: the size of the runs that are sorted in memory."""
    if buffer_bytes <= 0:
        raise ValueError("buffer_bytes must be positive")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(buffer_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Mark the jobs started inside, so that ``cancel`` with the same tag stops them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the marked jobs; they fail, so that no output is taken for complete."""
    spark.sparkContext.cancelJobsWithTag(tag)

"""Sorts, ranks, distinct lines, runs and merges.

The order is key, number, then the whole line and any further columns given, so
that it is total.  ``orderBy`` range-partitions on all of them: a key that holds
a third of the rows is still spread by number and line.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import compare, utf16_order, whole_part
from .parsing import parse_lines

ORDER = ("key", "number", "value")


def order_columns(order_by: Sequence[str | Column] | None = None, ties: Sequence[str] = (), utf16: bool = False) -> list[Column]:
    """Sort columns: those given, or key, number and line; then the tie-breakers."""
    first = order_by if order_by is not None else [utf16_order(F.col("key")) if utf16 else "key", *ORDER[1:]]
    return [F.col(c) if isinstance(c, str) else c for c in (*first, *ties)]


def sort_lines(lines: DataFrame, grammar: str = "lenient", on_error: str = "drop", order_by: Sequence[str | Column] | None = None, ties: Sequence[str] = (), utf16: bool = False) -> DataFrame:
    """All lines in order; equal lines are kept."""
    return parse_lines(lines, grammar, on_error).orderBy(*order_columns(order_by, ties, utf16))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs in one process."""
    context, path = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not path and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidemark-"))
    return context._jsc.sc().getCheckpointDir().get()


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add each row's place, from 1, in a total order.

    Range partitioning and a sort in each partition, then the partitions' row
    counts (one small row each) shift the places within partitions.  No task
    sees more than one range.  The sorted rows are checkpointed, as a second
    run might draw other range borders; Spark's cleaner deletes them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    checkpoint_folder(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, row, start = unused([*df.columns, name], "part", "row", "start")
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).checkpoint()
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(row))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(row).over(before), F.lit(0)).alias(start))
    shifted = placed.join(F.broadcast(starts), part)  # a row for each of n partitions
    return shifted.withColumn(name, F.col(start) + F.col(row) + 1).drop(part, row, start)


def rank_lines(lines: DataFrame, grammar: str = "lenient", ties: Sequence[str] = (), utf16: bool = False, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Parsed lines with ``pos``, their place in the sorted file."""
    return number_rows(parse_lines(lines, grammar), order_columns(order_by, ties, utf16))


def first_seen(parsed: DataFrame, seen: str, *within: str, same_by: Sequence[str | Column] = ("key", "number")) -> DataFrame:
    """One row for each key and number, or for each value of the columns given: the first by ``seen``."""
    columns = [F.col(c) if isinstance(c, str) else c for c in same_by]
    names = unused(parsed.columns, *(f"by{k}" for k in range(len(columns))), "first")
    kept = [c for c in parsed.columns if c not in within]
    first = F.min_by(F.struct(*kept), F.col(seen)).alias(names[-1])  # combined before the shuffle, so a frequent line is no hot spot
    by = [c.alias(n) for c, n in zip(columns, names, strict=False)]
    return parsed.groupBy(*within, *by).agg(first).select(*within, *(F.col(f"{names[-1]}.{c}").alias(c) for c in kept))


def distinct_order(order_by: Sequence[str | Column] | None) -> list[Column]:
    return order_columns(order_by) if order_by is not None else [F.col("key"), F.col("number")]


def sort_distinct(lines: DataFrame, seen: str, grammar: str = "lenient", order_by: Sequence[str | Column] | None = None, same_by: Sequence[str | Column] = ("key", "number")) -> DataFrame:
    """Lines with equal key and number (or ``same_by``) once, the first seen, in order."""
    return first_seen(parse_lines(lines, grammar), seen, same_by=same_by).orderBy(*distinct_order(order_by))


def batch_sort(lines: DataFrame, batch: str, seen: str, grammar: str = "lenient", order_by: Sequence[str | Column] | None = None, same_by: Sequence[str | Column] = ("key", "number")) -> DataFrame:
    """Each batch distinct and in order by itself, with ``pos`` in the batch."""
    within = Window.partitionBy(batch).orderBy(*distinct_order(order_by))
    distinct = first_seen(parse_lines(lines, grammar), seen, batch, same_by=same_by)
    return distinct.withColumn("pos", F.row_number().over(within).cast("long"))


def assign_runs(lines: DataFrame, line_no: str, lines_per_run: int) -> DataFrame:
    """Add ``run_idx`` (64 bits): consecutive lines by number, ``lines_per_run`` each."""
    if lines_per_run <= 0:
        raise ValueError("lines_per_run must be positive")
    return lines.withColumn("run_idx", whole_part(F.col(line_no).cast("long"), lines_per_run))


def sorted_runs(runs: DataFrame, ties: Sequence[str] = (), grammar: str = "lenient", order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Each run in order, with ``pos`` in the run."""
    within = Window.partitionBy("run_idx").orderBy(*order_columns(order_by, ties))
    return parse_lines(runs, grammar).withColumn("pos", F.row_number().over(within).cast("long"))


def run_heads(runs: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Per ``run_idx`` of parsed lines: the tie-breakers of its least line by key, number and these, and ``n_lines``."""
    least = runs.groupBy("run_idx").agg(F.min(F.struct("key", "number", *ties)).alias("least"), F.count(F.lit(1)).alias("n_lines"))
    return least.select("run_idx", *(F.col(f"least.{c}").alias(c) for c in ties), "n_lines")


def merge_runs(runs: Sequence[DataFrame], ties: Sequence[str] = (), order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The bag union of parsed runs in order; ties go to the lower run, then by line and ``ties``."""
    tagged = [r.withColumn("run_idx", F.lit(i).cast("long")) if "run_idx" not in r.columns else r for i, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, tagged).orderBy(*distinct_order(order_by), "run_idx", "value", *ties)


def concat_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Chunks one after the other, with ``chunk_idx``."""
    return reduce(DataFrame.unionByName, [c.withColumn("chunk_idx", F.lit(i)) for i, c in enumerate(chunks)])


def compare_lines(pairs: DataFrame, left: str = "left", right: str = "right", grammar: str = "lenient") -> DataFrame:
    """Add ``sign``: how the left line compares with the right one."""
    from ..functions.grammar import GRAMMARS

    number, key = GRAMMARS[grammar]
    a, b = F.col(left), F.col(right)
    return pairs.withColumn("sign", compare(key(a), number(a), key(b), number(b)))

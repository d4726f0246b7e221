"""Reading text files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import strip_cr


def read_lines(spark: SparkSession, path: str | list[str], newline_only: bool = False, valid_utf8: bool = True) -> DataFrame:
    """``value`` per line, blank lines included.

    Lines end at ``\\n``, ``\\r\\n`` or ``\\r``; with ``newline_only`` at ``\\n``,
    and one ``\\r`` before it is cut.  A mark at the start of a file goes, one
    inside is data.  Bytes that are no UTF-8 become U+FFFD unless
    ``valid_utf8`` is off.  A missing path raises ``AnalysisException``.
    """
    reader = spark.read.option("lineSep", "\n") if newline_only else spark.read
    lines = reader.text(path)
    value = F.make_valid_utf8("value") if valid_utf8 else F.col("value")
    return lines.select((strip_cr(value) if newline_only else value).alias("value"))


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with ``run``, the file that each came from, and ``run_idx`` where the folders are named by it."""
    lines = spark.read.text(paths)
    named = [F.col("run_idx").cast("long").alias("run_idx")] if "run_idx" in lines.columns else []
    return lines.select("value", F.col("_metadata.file_path").alias("run"), *named)


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` and ``line_no`` from 1, in the order of files and of lines in them.

    No line is moved: the pieces that files are read in are counted, one small
    row each, and a line's place in its piece is added to the lines of the
    pieces before.
    """
    piece, at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")], F.monotonically_increasing_id().alias("at")
    pieces = spark.read.text(path).select(*piece, at).groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    lines = spark.read.text(path).select("value", *piece, at)
    numbered = lines.join(F.broadcast(starts), ["file", "block"])  # a row for each task that reads
    return numbered.select("value", (F.col("at") + F.col("shift") + 1).alias("line_no"))


def count_lines(lines: DataFrame) -> int:
    return lines.count()

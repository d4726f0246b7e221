"""Running sums that cut a sequence of lines at a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import line_bytes, line_chars, whole_part
from .ordering import unused


def _cut_block(lines: DataFrame, order: str, size: Column, block: int, target: int, ahead: int) -> tuple[int, int] | None:
    """The first block of ids with which the sum, ``ahead`` at first, is beyond ``target``, and the sum before it."""
    sums = lines.groupBy(whole_part(F.col(order).cast("long"), block).alias("block")).agg(F.sum(size).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + ahead
    found = sums.withColumn("before", before).where(F.col("before") + F.col("bytes") > target).orderBy("block").first()
    return (found["block"], found["before"]) if found else None


def _fitting(lines: DataFrame, order: str, size: Column, target: int, block: int, fits) -> DataFrame:
    """Lines in order as long as ``fits(sum before, size)``, which no line does that ends beyond ``target`` but at most one.

    The block of ids in which the sum passes the target is looked for among
    blocks of ``block`` squared ids and then in that one; only its lines need a
    running sum.  All before it are taken as they are, none after it is read.
    """
    column, low, ahead = F.col(order), None, 0
    for width in (block * block, block):
        within = lines if low is None else lines.where(column.between(low, low + block * block - 1))
        found = _cut_block(within, order, size, width, target, ahead)
        if not found:
            return lines
        low, ahead = found[0] * width, found[1]
    before, own = unused(lines.columns, "before", "size")
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one block
    last = lines.where(column.between(low, low + block - 1)).withColumn(own, size)
    last = last.withColumn(before, F.coalesce(F.sum(own).over(upto), F.lit(0)) + ahead)
    return lines.where(column < low).unionByName(last.where(fits(F.col(before), F.col(own))).drop(before, own))


def byte_budget_cut(lines: DataFrame, order: str, target: int, block: int = 65_536) -> DataFrame:
    """Lines in order (of different whole numbers) until ``target`` bytes are reached; the last may exceed it."""
    return _fitting(lines, order, line_bytes(F.col("value")), target - 1, block, lambda before, size: before < target)


def char_budget_cut(lines: DataFrame, order: str, target: int, block: int = 65_536) -> DataFrame:
    """Lines in order (of different whole numbers) as long as they stay within ``target`` characters."""
    return _fitting(lines, order, line_chars(F.col("value")), target, block, lambda before, size: before + size <= target)


def chunk_offsets(chunks: DataFrame, order: str, size: str) -> DataFrame:
    """Add ``offset``: where each chunk starts when they are put together."""
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(size).over(ahead), F.lit(0)))

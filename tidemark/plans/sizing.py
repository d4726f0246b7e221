"""Advisory sizes as 64-bit column expressions."""

from __future__ import annotations

import shutil

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.grammar import whole_part

#: The least buffer, the two file sizes from which a smaller
#: share of the file is the most, and the most there.
LEAST = 64 * 1024
OVER_50 = 50 * 1024**3
OVER_100 = 100 * 1024**3
MOST_OVER_50 = 50 * 1024**2
MOST_OVER_100 = 25 * 1024**2


def _div(a: Column, n: int) -> Column:
    return whole_part(a.cast("long"), n)


def _power_of_two(x: Column) -> Column:
    """The least power of two that is not below ``x``, from its binary digits: no logarithm rounds."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def buffer_size(requested: Column, file_size: Column, parallel: bool = False) -> Column:
    """A power of two of at least 64 KiB, limited by a share of the file."""
    least = F.lit(LEAST).cast("long")
    most = F.greatest(_div(file_size, 10), least)
    if not parallel:
        large = F.least(_div(file_size, 50), F.lit(MOST_OVER_100).cast("long"))
        middle = F.least(_div(file_size, 20), F.lit(MOST_OVER_50).cast("long"))
        most = F.when(file_size > OVER_100, large).when(file_size > OVER_50, middle).otherwise(most)
    return _power_of_two(F.least(F.greatest(requested, least), most))


def lines_per_chunk(buffer: Column) -> Column:
    return F.greatest(F.lit(1000).cast("long"), _div(buffer, 200))


def lines_per_parallel_chunk(buffer: Column, lines: Column, threads: int) -> Column:
    floor_ = F.greatest(F.greatest(F.lit(100).cast("long"), _div(buffer, 200)), _div(lines, 2 * threads))
    many = F.least(floor_, F.least(_div(buffer, 100), lines))
    return F.when(lines <= 10, F.greatest(F.lit(1).cast("long"), lines)).otherwise(many)


def merge_passes(runs: Column, ways: int = 10) -> Column:
    """Passes that merge ``runs`` files, ``ways`` at a time; exact, without logarithms' rounding."""
    passes, reach, expr = 0, 1, F.lit(0)
    steps = []
    while reach < 1 << 62:
        steps.append((reach, passes))
        reach *= ways
        passes += 1
    for at_least, n in steps:
        expr = F.when(runs > at_least, n + 1).otherwise(expr)
    return expr.cast("int")


def chunk_count(target: Column, chunk: int) -> Column:
    return whole_part(target.cast("long") + (chunk - 1), chunk)


def batch_lines(batch: Column, remaining: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(batch, _div(remaining, 50)))


def disk_is_short(folder: str, file_size: int) -> bool:
    """Whether less than three times the file is free (for local folders)."""
    return shutil.disk_usage(folder).free < 3 * file_size

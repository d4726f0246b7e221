"""Parsing and rejecting lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import GRAMMARS


def parse_lines(lines: DataFrame, grammar: str = "lenient", on_error: str = "drop") -> DataFrame:
    """Add ``key`` and ``number`` to a frame with ``value``.

    Rejected lines (never any under ``lenient``) are dropped, kept with null
    ``key`` and ``number``, or make the job fail: ``on_error`` is ``drop``,
    ``keep`` or ``raise``.  Columns called ``key`` or ``number`` are replaced.
    """
    if grammar not in GRAMMARS or on_error not in ("drop", "keep", "raise"):
        raise ValueError(f"unknown grammar or on_error: {grammar!r}, {on_error!r}")
    number, key = (f(F.col("value")) for f in GRAMMARS[grammar])
    if on_error == "raise" and grammar != "lenient":
        said = F.raise_error(F.concat(F.lit("Malformed line: "), F.coalesce("value", F.lit("null")))).cast("int")
        number = F.when(number.isNull(), said).otherwise(number)
    if on_error == "drop":
        # what follows the filter need not look at rejected lines again
        return lines.withColumn("number", number).where(F.col("number").isNotNull()).withColumn("key", key)
    return lines.withColumns({"key": key, "number": number})


def rejected_lines(lines: DataFrame, grammar: str = "strict") -> DataFrame:
    """The lines that a grammar rejects."""
    return lines.where(GRAMMARS[grammar][0](F.col("value")).isNull())


def check_length(lines: DataFrame, max_chars: int) -> DataFrame:
    """Fail the job at a line longer than ``max_chars``; a null line has no length and passes."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    fits = F.coalesce(F.char_length("value") <= max_chars, F.lit(True))
    return lines.where(F.assert_true(fits, F.lit("line too long")).isNull())

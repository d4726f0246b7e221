"""Reproducible files of random lines up to a size.

Every line is a function of the seed, its chunk and its id, so any task can make
any part of the file.  A first pass sums the sizes of blocks of lines without
making the lines, the second makes the blocks before the target and cuts the one
that reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grammar import format_line, line_bytes, whole_part
from ..operators.ordering import checkpoint_folder

BLOCK = 1 << 18
CHUNK = 100 << 20
LARGEST = 999_999
MOST_TASKS = 100_000
PER_LINE = 50  # bytes of a chunk's offset for each number that it shifts its lines by
WORDS = ("amber field", "Birch", "cold river stone", "Dune", "ember", "fallow deer at dawn", "Granite", "harbour light", "iris", "Juniper hill", "kestrel", "low tide", "Meadow", "north wind over water", "ochre", "pine")


def hashed(id_: Column, seed: int, what: str) -> Column:
    """The number that a line's number or word is drawn by."""
    return F.xxhash64(F.lit(seed), F.lit(what), id_)


def random_number(id_: Column, seed: int, offset: Column | int = 0, draw: Callable = hashed) -> Column:
    """1 to 999,999, shifted by a fiftieth of the offset of the line's chunk."""
    shift = whole_part(offset if isinstance(offset, Column) else F.lit(offset).cast("long"), PER_LINE)
    return F.pmod(draw(id_, seed, "number"), F.lit(LARGEST).cast("long")) + 1 + shift


def word_place(id_: Column, seed: int, words: Sequence[str], draw: Callable = hashed) -> Column:
    return (F.pmod(draw(id_, seed, "word"), F.lit(len(words)).cast("long")) + 1).cast("int")


def random_word(id_: Column, seed: int, words: Sequence[str], draw: Callable = hashed) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), word_place(id_, seed, words, draw))


def _number(id_: Column, place: Column, offset: Column, seed: int, numbers: str, draw: Callable) -> Column:
    """Random, or one after the other in a chunk."""
    return random_number(id_, seed, offset, draw) if numbers == "random" else place + 1 + whole_part(offset, PER_LINE)


def generate_lines(
    spark: SparkSession,
    target_bytes: int,
    words: Sequence[str] = WORDS,
    seed: int = 0,
    numbers: str = "random",
    exceed: bool = True,
    block: int = BLOCK,
    chunk_bytes: int | None = None,
    draw: Callable = hashed,
) -> DataFrame:
    """``chunk, place, value``: chunks of ``chunk_bytes`` (one, unless given) that make up about ``target_bytes`` with newlines.

    ``numbers`` is ``random`` or ``sequential``; both are shifted by a fiftieth
    of the chunk's offset.  With ``exceed`` a chunk's last line reaches or
    passes the chunk's size, else no line passes it.  ``place`` counts a chunk's
    lines from 0; ``draw`` may be given to have other random numbers.
    """
    chunk = target_bytes if chunk_bytes is None else chunk_bytes
    if target_bytes <= 0 or block <= 0 or chunk <= 0:
        raise ValueError("sizes must be positive")
    if not words or any(not w for w in words):
        raise ValueError("words must be given and not be empty")
    if numbers not in ("random", "sequential"):
        raise ValueError(f"unknown numbers: {numbers!r}")
    sizes = [len(w.encode()) for w in words]
    chunk = min(chunk, target_bytes)
    most = -(-chunk // (min(sizes) + 4))  # lines of a chunk if all were the shortest
    # as many as the mean size needs and ten standard deviations more; all only if that is too little
    digits = 5.5 if numbers == "random" else max(1.0, math.log10(chunk / (max(sizes) + 13)) - 0.5)
    mean = sum(sizes) / len(sizes) + 3 + digits
    likely = math.ceil(chunk / mean + 10 * (max(sizes) + 6) / mean * math.sqrt(chunk / mean)) + 100
    chunks = -(-target_bytes // chunk)

    def of_chunks(blocks: DataFrame) -> DataFrame:
        """Blocks with the place of each of their lines and its number."""
        start = F.col("block") * block
        lines = blocks.withColumn("place", F.explode(F.sequence(start, start + (block - 1))))
        id_ = F.col("chunk") * F.lit(most).cast("long") + F.col("place")
        return lines.withColumns({"id": id_, "number": _number(id_, F.col("place"), F.col("offset"), seed, numbers, draw)})

    size_of = F.element_at(F.array(*map(F.lit, sizes)), word_place(F.col("id"), seed, words, draw))
    line_size = (F.octet_length(F.col("number").cast("string")) + 3 + size_of).cast("long")
    fits = F.col("before") < F.col("size") if exceed else F.col("before") + F.col("bytes") <= F.col("size")
    checkpoint_folder(spark)
    for n in dict.fromkeys((-(-min(likely, most) // block), -(-most // block))):
        ids = spark.range(0, chunks * n, 1, min(MOST_TASKS, chunks * n)).select(whole_part(F.col("id"), n).alias("chunk"), (F.col("id") % n).alias("block"))
        blocks = ids.withColumn("offset", F.col("chunk") * chunk)
        blocks = blocks.withColumn("size", F.least(F.lit(chunk).cast("long"), F.lit(target_bytes).cast("long") - F.col("offset")))
        sums = of_chunks(blocks).groupBy("chunk", "offset", "size", "block").agg(F.sum(line_size).alias("bytes"))
        ahead = Window.partitionBy("chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
        used = sums.where("before < size").checkpoint()
        if used.where(F.col("before") + F.col("bytes") >= F.col("size")).count() == chunks:
            break
    else:
        raise AssertionError("the upper bound of lines is too small")
    line = format_line(F.col("number"), random_word(F.col("id"), seed, words, draw))
    spread = used.repartitionByRange(min(MOST_TASKS, used.count()), "chunk", "block")
    whole = of_chunks(spread.where(F.col("before") + F.col("bytes") <= F.col("size"))).select("chunk", "place", line.alias("value"))
    inside = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one block
    last = of_chunks(used.where(F.col("before") + F.col("bytes") > F.col("size")))
    last = last.select("chunk", "place", "size", "before", line.alias("value")).withColumn("bytes", line_bytes(F.col("value")))
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return whole.unionByName(last.where(fits).select("chunk", "place", "value"))


def chunk_plan(spark: SparkSession, target_bytes: int, chunk_bytes: int) -> DataFrame:
    """``chunk, offset, size`` of the chunks that make up a target."""
    if target_bytes <= 0 or chunk_bytes <= 0:
        raise ValueError("sizes must be positive")
    offset = F.col("id") * chunk_bytes
    return spark.range(-(-target_bytes // chunk_bytes)).select(F.col("id").alias("chunk"), offset.alias("offset"), F.least(F.lit(chunk_bytes).cast("long"), target_bytes - offset).alias("size"))


#: Kinds of generators by name: arguments for ``generate_lines``.
KINDS = {"basic": {}, "batched": {"block": BLOCK >> 2}, "parallel": {"chunk_bytes": CHUNK}, "chunk_buffer": {"numbers": "sequential", "exceed": False, "chunk_bytes": CHUNK}}


def generator(kind: str, words: Sequence[str] = WORDS, seed: int = 0, **options):
    """A function (spark, target_bytes) -> lines; ``options`` are further arguments for ``generate_lines``."""
    arguments = KINDS[kind] | options
    return lambda spark, target_bytes: generate_lines(spark, target_bytes, words, seed, **arguments)

"""Removal of repeated runs of lines, with DataFrame functions alone.

The lines of all documents, as line numbers, are one sequence with the ends of
documents between them.  Prefix doubling sorts its suffixes: after round k two
suffixes have one rank exactly if their first 2^k lines are the same, and ranks
follow the order of these lines.  Suffixes of one rank are an interval of the
suffix array whose common prefix has at least 2^k lines.  Intervals of one
suffix need no further round, so what is sorted shrinks to what repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_sized, release, rows_of, unused

RUN = "array<struct<start:int,lines:int,first_doc:long,first_start:int>>"


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, lines``: per different (id, text) place and hash of each line that is not blank."""
    rows = rows_of(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col).where("text IS NOT NULL")
    every = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.when(~is_blank(x), F.xxhash64(x)).alias("hash")))
    lines = F.filter(every, lambda x: x["hash"].isNotNull())
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines")).dropDuplicates(["doc_id", "text_hash"])


def ranked(pairs: DataFrame) -> DataFrame:
    """Suffixes (``last, o, d, pos, i``) with keys (``a, b``): those whose keys repeat, with the keys' ``rank`` and their ``first`` suffix.

    Keys are counted before they are shuffled and sorted by ranges without
    repetition, and the keys of very many suffixes come to these by broadcast,
    so that a very frequent line is no hot spot.
    """
    spark = pairs.sparkSession
    own = F.struct("last", "o", "d", "pos", "i")
    groups = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size"), F.min(own).alias("first")).where("size > 1")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = groups.repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id() + 1)
    order = cut(order.select("a", "b", "size", "first", "rank"))
    out = cut(join_sized(pairs, order, ["a", "b"], "size").select("last", "o", "d", "pos", "i", "rank", "first"))
    release(spark)
    return out


def ahead(level: DataFrame, width: int) -> DataFrame:
    """Suffixes whose key is their own rank and that of the suffix ``width`` lines further on."""
    there = Window.partitionBy("d").orderBy("pos").rangeBetween(width, width)
    return level.select("last", "o", "d", "pos", "i", F.col("rank").alias("a"), F.max("rank").over(there).alias("b")).where("b IS NOT NULL")


def suffix_ranks(hashes: DataFrame) -> list[DataFrame]:
    """``last, o, d, pos, i, rank, first`` of the suffixes that share 1, 2, 4, ... first lines with another.

    ``hashes`` has ``last`` and ``o`` (a document's place in the order), ``d``
    (its number) and its lines, numbered by ``pos`` without the blank ones and
    by ``i`` with them.  ``first`` is the earliest suffix with these lines.
    """
    lines = hashes.select("last", "o", "d", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("last", "o", "d", "pos", "line.i", F.col("line.hash").alias("a"), F.lit(0).cast("long").alias("b"))
    levels, width = [ranked(lines)], 1
    while True:
        level = ranked(ahead(levels[-1], width))
        if not level.limit(1).count():
            return levels
        levels.append(level)
        width *= 2


def maximal_runs(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """``d, runs``: each document's maximal repeated runs of ``min_lines`` lines or more, in order.

    In a level of width w the suffixes of one rank are an interval with a common
    prefix of w lines; all but the first of it are later copies.  Later copies
    one after the other whose first suffixes are one after the other too are
    one run of as many lines and w - 1 more.  A run that lies within another is
    dropped: the level next below a run's length gives it whole, the levels
    below that only parts of it.
    """
    base = min_lines.bit_length() - 1
    used = [(1 << k, level) for k, level in enumerate(levels) if 1 << k >= min_lines]
    if min_lines != 1 << base and base < len(levels):  # two overlapping intervals make up the shortest runs
        used.insert(0, (min_lines, ranked(ahead(levels[base], min_lines - (1 << base)))))
    if not used:
        return levels[0].where("false").select("d", F.lit(None).cast("array<struct<pos:int,lines:int,last:boolean,first_doc:long,first_start:int>>").alias("runs"))
    copies = None
    for width, level in used:
        later = level.where((F.col("d") != F.col("first.d")) | (F.col("pos") != F.col("first.pos")))
        later = later.select("d", "pos", F.lit(width).alias("width"), "first")
        copies = later if copies is None else copies.unionByName(later)
    row = Window.partitionBy("d").orderBy("width", "pos")
    before = {c: F.lag(c).over(row) for c in ("width", "pos", "first.d", "first.pos")}
    goes_on = (before["width"] == F.col("width")) & (before["pos"] == F.col("pos") - 1) & (before["first.d"] == F.col("first.d")) & (before["first.pos"] == F.col("first.pos") - 1)
    numbered = copies.withColumn("run", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("run").over(row))
    lines = (F.count(F.lit(1)) + F.max("width") - 1).cast("int")
    runs = numbered.groupBy("d", "run").agg(F.min("pos").alias("pos"), lines.alias("lines"), F.max("width").alias("width"), F.min("first").alias("first"))
    end, order = F.col("pos") + F.col("lines"), Window.partitionBy("d").orderBy("pos", F.desc("lines"), F.desc("width"))
    whole = runs.withColumn("reached", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("reached").isNull() | (end > F.col("reached")))
    run = F.struct("pos", "lines", "first.last", F.col("first.o").alias("first_doc"), F.col("first.i").alias("first_start"))
    return whole.groupBy("d").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # a document's lines at most


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed``, ``runs`` and ``kept``, the text without later copies of repeated runs.

    Lines end at 0x0A.  Blank lines (spaces and 0x09 to 0x0D at most) are no
    part of a run, do not end one and stay.  A run of ``min_lines`` lines or
    more that also stands earlier, in a document with a smaller id or further
    up in its own, is deleted; the first copy stays.  All runs are judged on
    the input.  A text without deleted lines stays as it is.

    ``runs`` are the maximal ones: for each the number of its first line
    (from 0), how many lines it has without blank ones, and the document and
    line where its first copy starts.  They may overlap.

    Null texts have no lines and stay null; empty texts have one blank line.
    A null id comes after all others.  Rows with equal id and text are one
    document and fare alike; equal ids with different texts are documents of
    their own.  Other columns go along whatever their names; ``n_lines``,
    ``n_removed``, ``runs`` and ``kept`` are replaced.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "runs", "kept")]
    own_id, own_hash, found_runs, gone, split = unused(names, "id", "hash", "runs", "gone", "lines")
    hashes = cut(line_hashes(docs, id_col, text_col))
    hashes = hashes.withColumns({"last": F.col("doc_id").isNull(), "o": F.coalesce("doc_id", F.lit(0)), "d": F.monotonically_increasing_id()})
    by_doc = cut(maximal_runs(suffix_ranks(hashes), min_lines))
    release(spark)
    placed = by_doc.join(hashes.select("d", "doc_id", "text_hash", "lines"), "d")
    places = F.flatten(F.transform("runs", lambda r: F.transform(F.slice("lines", r["pos"] + 1, r["lines"]), lambda x: x["i"])))
    said = F.transform("runs", lambda r: F.struct(F.get("lines", r["pos"])["i"].alias("start"), r["lines"].alias("lines"), F.when(~r["last"], r["first_doc"]).alias("first_doc"), r["first_start"].alias("first_start")))
    keyed = placed.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), said.alias(found_runs), F.array_distinct(places).alias(gone))
    text, rows = F.col(f"`{text_col}`"), docs.select(*(F.col(f"`{c}`") for c in names))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash))
    found = rows.join(keyed.hint("shuffle_hash"), same, "left")
    # the split text is a column, as in a lambda it would be split again for each line
    found = found.withColumn(split, lines_of(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return found.select(
        *(F.col(f"`{c}`") for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.coalesce(found_runs, F.array().cast(RUN)).alias("runs"),
        F.when(F.col(gone).isNull(), text).otherwise(kept).alias("kept"),
    )

"""Batch-wise sorted, distinct lines from a stream of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import first_seen
from ..operators.parsing import parse_lines
from ..operators.sinks import _folder


def number_files(batch: DataFrame, first: int, files_per_batch: int) -> list[tuple[str, int, int]]:
    """The files of a trigger's lines, each with the number of its batch, by time and path, and its place by path."""
    found = batch.groupBy("_file").agg(F.min(F.unix_micros("_time")).alias("time")).collect()  # a row for each file of a trigger
    place = {path: k for k, path in enumerate(sorted(r._file for r in found))}
    return [(path, first + k // files_per_batch, place[path]) for k, (_, path) in enumerate(sorted((r.time, r._file) for r in found))]


def sort_batches(batch: DataFrame, files: list[tuple[str, int, int]], grammar: str = "lenient") -> DataFrame:
    """Each batch of a trigger distinct by key and number, the first line seen, and in order by itself."""
    numbers = batch.sparkSession.createDataFrame(files, "_file string, batch long, _place int")
    placed = batch.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(numbers), "_file")
    lines = placed.select("value", "batch", F.struct("_place", "_block", "_id").alias("_at"))
    return first_seen(parse_lines(lines, grammar), "_at", "batch").orderBy("batch", "key", "number").select("value", "batch")


def first_number(spark: SparkSession, checkpoint: str, n: int) -> int:
    """The number of a trigger's first batch; where none is kept, each trigger before had one batch."""
    at, fs = _folder(spark, f"{checkpoint}/batches/{n}")
    if not fs.exists(at):
        return n
    kept = fs.open(at)
    try:
        return int(kept.readLine())
    finally:
        kept.close()


def keep_number(spark: SparkSession, checkpoint: str, n: int, first: int) -> None:
    at, fs = _folder(spark, f"{checkpoint}/batches/{n}")
    out = fs.create(at, True)
    try:
        out.writeBytes(f"{first}\n")
    finally:
        out.close()


def batch_sort_stream(spark: SparkSession, source: str, target: str, checkpoint: str, grammar: str = "lenient", files_per_batch: int = 1, batches_per_trigger: int = 1000) -> StreamingQuery:
    """Sort what is in ``source`` batch by batch into ``target/batch=<n>``.

    A batch is ``files_per_batch`` files that hold lines, by time and path; the
    last one of a trigger may have fewer.  Nothing is kept between batches.  As
    a trigger costs its planning and its logs however little it reads, it sorts
    up to ``batches_per_trigger`` batches in one job, each by itself; its files
    are read twice, first for their names, and so are their rows counted in the
    stream's progress.  Batches are numbered through all triggers;
    ``checkpoint/batches/<trigger>`` keeps the number of a trigger's first.  A
    trigger that runs again after a failure thus replaces its own folders, so no
    line is written twice.  Spark 4.1 reads a file with a bracket in its name
    once for each file of the trigger; this changes no result, but with many
    such names take ``batches_per_trigger=1``.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch * batches_per_trigger).text(source)
    about = {"_file": "file_path", "_block": "file_block_start", "_time": "file_modification_time"}
    stream = stream.select("value", *(F.col(f"_metadata.{c}").alias(name) for name, c in about.items()))

    def write(batch: DataFrame, n: int) -> None:
        first = first_number(spark, checkpoint, n)
        files = number_files(batch, first, files_per_batch)
        if files:
            sort_batches(batch, files, grammar).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(target)
        keep_number(spark, checkpoint, n + 1, files[-1][1] + 1 if files else first)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Web pages to seekable WARC bundles and back."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import checkpoint_dir, cut, rows_of

FRAME = 1 << 18  # bytes of records in a frame
BUNDLE = 1 << 22  # and in a bundle, about
LEAST_PAYLOAD = 100

PLACE = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
BUNDLES = "data binary, records array<struct<record_id: string, frame: int, offset: long, length: long>>"
FACTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_responses(pages: DataFrame, least: int) -> DataFrame:
    """Add ``digest`` and ``first``, the smallest id with an equal payload where there is more than one row.

    Payloads of a digest meet only as partial minima; the join on the digests
    that repeat can be split where one of them holds many rows.  Payloads too
    short to be linked have a key of their own each, so that the very frequent
    ones among them do not meet.
    """
    hashed = pages.withColumn("digest", F.sha2("payload", 256))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id())
    hashed = hashed.withColumn("key", F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(alone))
    groups = hashed.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("key"))
    repeated = groups.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    return hashed.join(cut(repeated), "key", "left").drop("key")  # written first, else a key's rows cannot be split


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record per row as seekable Zstandard bundles.

    The bundles are rows of a Parquet table at ``path`` (any store that Spark
    writes to): ``data``, the bundle's bytes, and ``records``, which maps each
    record's identifier to its frame and its offset and length in that frame.
    Of equal payloads of ``least`` bytes or more the row with the smallest id
    is a response, the others revisit it; shorter payloads are all responses.

    Null html is an empty payload, a null url is left out.  Rows that repeat
    the smallest id are responses too; a null id is never the smallest unless
    there is no other, and then all are responses.  Extra columns are ignored.
    An empty table gives an empty table of bundles.
    """

    def pack(batches):
        bundle, places = seekable.Bundle(frame_bytes), []

        def close():
            row = [pa.array([bundle.close()], pa.binary()), pa.array([places], pa.list_(PLACE))]
            return pa.RecordBatch.from_arrays(row, ["data", "records"])

        for batch in batches:
            for page, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                revisit = first is not None and first != page
                record = seekable.make_record(page, url, payload, digest, first, revisit, date)
                places.append(dict(zip(("record_id", "frame", "offset", "length"), (seekable.record_id(page), *bundle.add(record)), strict=True)))
                if bundle.raw >= bundle_bytes:
                    yield close()
                    bundle, places = seekable.Bundle(frame_bytes), []
        if places:
            yield close()

    rows = rows_of(pages, page_id=F.col(f"`{id_col}`").cast("long"), url=url_col, payload=F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")))
    linked = with_responses(rows, least).select("page_id", "url", "payload", "digest", "first")
    linked.mapInArrow(pack, BUNDLES).write.mode("overwrite").option("compression", "none").parquet(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the bundles alone.

    Every frame is found through the seek table and unpacked, every record
    parsed and held against the table of places, every payload's digest
    computed again; what does not fit raises a ``ValueError``.  An empty table of
    bundles gives no rows, records that repeat an identifier a row each; further
    columns of the table are ignored.
    """

    def unpack(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for data, places in zip(batch.column("data").to_pylist(), batch.column("records").to_pylist(), strict=True):
                expected = iter(places)
                for number, place in enumerate(seekable.seek_table(data)):
                    for offset, record in seekable.parse_records(seekable.frame(data, place)):
                        want, own = next(expected), record.headers["WARC-Record-ID"]
                        if (want["record_id"], want["frame"], want["offset"]) != (own, number, offset):
                            raise ValueError(f"{own} is not where the table has it")
                        kind = record.headers["WARC-Type"]
                        other = seekable.page_of(record.headers["WARC-Refers-To"]) if kind == "revisit" else None
                        for column, v in zip(out, (seekable.page_of(own), *seekable.payload_facts(record), kind, other), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in FACTS.split(", ")])

    return spark.read.parquet(path).mapInArrow(unpack, FACTS)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write bundles and read them back; without a path they go once they are read."""
    spark = pages.sparkSession
    if path is not None:
        write_bundles(pages, path, **options)
        return read_bundles(spark, path)
    path = f"{checkpoint_dir(spark)}/warc-{os.urandom(8).hex()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write_bundles(pages, path, **options)
        return cut(read_bundles(spark, path))
    finally:
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

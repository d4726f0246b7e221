"""SentencePiece encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_model
from .common import only, parts, rows_of, text_rows

STEP = 4 << 20  # bytes of text looked at together


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: each text's ids under the model file, as the library gives them.

    Null and empty texts have no ids.  Bytes that are no UTF-8 count as U+FFFD.
    Null ids and repeated rows give a row each; extra columns are ignored; an
    empty table gives no rows.
    """

    def run(batches):
        only(piece_model)
        pieces = piece_model.load(model)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for _, _, texts in parts(batch, STEP) for x in pieces.encode(texts)]
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each list of ids; null lists count as empty."""

    def run(batches):
        pieces = piece_model.load(model)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = rows_of(encoded, doc_id=F.col(f"`{id_col}`").cast("long"), ids=F.col(f"`{ids_col}`").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_ids, ids_crc32, decoded_sha256, same``: each text encoded and decoded in one pass.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit values, ``same``
    whether decoding gives the text back.  Nulls and the like as in ``encode``.
    """
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "same": pa.bool_()}

    def run(batches):
        only(piece_model)
        pieces = piece_model.load(model)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, texts in parts(batch, STEP):
                rows = []
                for doc, text, packed in zip(ids[i:j], texts, pieces.encode(texts), strict=True):
                    back = pieces.decode(np.frombuffer(packed, "<u4"))
                    rows.append((doc, len(text), len(packed) // 4, zlib.crc32(packed), hashlib.sha256(back).hexdigest(), back == text))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")

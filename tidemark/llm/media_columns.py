"""Texts as pictures: stored as baseline JPEG, read back, described."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import only, parts, text_rows

STEP = 4 << 20  # payload bytes coded together

FIELDS = {
    "doc_id": pa.int64(),
    "n_bytes": pa.int64(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "feature": pa.string(),
    "width": pa.int32(),
    "height": pa.int32(),
    "thumbnail_hash": pa.string(),
}
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"


def padded(text: bytes) -> bytes:
    """With bytes 32 up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // jpeg.MCU)) * jpeg.MCU - len(text))


def describe(n_bytes: int, media: bytes, picture: jpeg.Picture) -> tuple:
    """The columns of one stored picture, all but ``n_bytes`` from its bytes."""
    read, seen = jpeg.payload(picture), jpeg.average_hash(jpeg.thumbnail(picture))
    feature = f"{picture.width}x{picture.height}:{seen}"
    return n_bytes, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, picture.width, picture.height, seen


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text losslessly as a baseline JPEG and describe what is read back.

    Columns: the id, ``n_bytes`` of the text, size, SHA-256 and CRC-32 of the
    last 16 bytes of the payload as read back, size and SHA-256 of the file,
    width and height in pixels, a 64-bit average hash of the DC-only luminance
    thumbnail, ``feature`` (size and hash as one string) and, on request,
    ``media``, the file.

    Null text counts as empty; an empty text is 192 spaces.  Equal texts give
    equal values.  Null ids and repeated rows give a row each; extra columns
    are ignored; an empty table gives no rows.  A text is coded whole, in
    memory that is a small multiple of its size.
    """

    def run(batches):
        only(None)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, texts in parts(batch, STEP):
                files = jpeg.encode([padded(t) for t in texts])
                pictures = jpeg.decode(files)
                rows = [(d, *describe(len(t), f, p)) for d, t, f, p in zip(ids[i:j], texts, files, pictures, strict=True)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)]
                names = [*FIELDS]
                if keep_media:
                    columns.append(pa.array(files, pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, SCHEMA + (", media binary" if keep_media else ""))

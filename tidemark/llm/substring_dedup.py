"""Removal of word runs that an earlier document holds as well.

Non-overlapping blocks of 7 words are the reference index; every rolling window
of 7 words probes it.  Any 13 words that occur twice hold a whole block of the
earlier document, so windows of 13 around hits are all that can be repeats.
These are keyed and held against each other exactly, which extends every hit
to the maximal exact repeat around it.

Documents are looked at in sheets of about a megabyte, so that what goes
through the shuffles are packed arrays, a value once for each sheet however
often it occurs there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, parts, release, text_rows
from .hashing import U, window_hashes, word_hashes

WINDOW = 13
SHEET = 1 << 20  # bytes of text in a sheet, about; a longer document is one by itself
NULL_ID = np.iinfo(np.int64).max  # in the order, a null id counts as the largest
BUCKET = 32 << 20  # bytes of keys that one task decides on, about

SHEETS = "sheet long, ids binary, nulls binary, sizes binary, data binary, carried binary"
REPLY = "sheet long, step int, bucket int, bits binary"


def block_size(window: int) -> int:
    """The largest block of which any ``window`` consecutive words hold a whole one."""
    return (window + 1) // 2


def pack_sheets(docs: DataFrame, id_col: str, text_col: str, sheet_bytes: int, carry: bool) -> DataFrame:
    """Rows of documents, packed; ``sheet`` numbers them.

    With ``carry`` all columns but the text go along, and whether it is null.
    """
    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(c for c in docs.columns if c != text_col)] if carry else []

    def run(batches):
        only(None)
        number, packer = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            rest = batch.select(batch.schema.names[2:])
            for i, j, texts in parts(batch, sheet_bytes):
                sizes = np.array([len(t) for t in texts], np.int64)
                row = ids[i:j].tobytes(), nulls[i:j].tobytes(), sizes.tobytes(), packer.compress(b"".join(texts)), packer.compress(as_stream(rest.slice(i, j - i))) if carry else b""
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v], pa.binary()) for v in row)], ["sheet", "ids", "nulls", "sizes", "data", "carried"])
                number += 1

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *([*others, text.isNull().alias("null")] if carry else []))
    return rows.mapInArrow(run, SHEETS)


def as_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


class Sheet:
    """A sheet's texts, their words' hashes and the document of each word."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids, ends = np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
        whole = zstandard.ZstdDecompressor().decompress(data)
        self.texts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.words, self.counts = word_hashes(self.texts)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def windows(self, n: int) -> np.ndarray:
        """Starts of the windows of ``n`` words that lie in one document."""
        last = len(self.words) - n + 1
        return np.flatnonzero(self.doc[: max(0, last)] == self.doc[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def anchors(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of ``n``, their distinct keys in order and each window's place among these.

        A key is the bucket's ``bits`` and 32 more of the window's hash.
        """
        at = self.windows(n)
        keys = window_hashes(self.words, n)[at] >> U(32 - bits)
        distinct, place = np.unique(keys, return_inverse=True)
        return at, distinct, place

    def flags(self, n: int, at: np.ndarray, distinct: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct key: whether it is a block of a document here, and whether two documents have it."""
        aligned = np.zeros(len(distinct), bool)
        aligned[place[(at - self.first[self.doc[at]]) % n == 0]] = True
        low, high = np.full(len(distinct), len(self.ids)), np.full(len(distinct), -1)
        np.minimum.at(low, place, self.doc[at])
        np.maximum.at(high, place, self.doc[at])
        return aligned, high > low

    def repeats(self, window: int, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around hits: starts, distinct 80-bit keys (as two arrays) and each window's place."""
        n, starts = block_size(window), self.windows(window)
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[hit] + 1] = 1
        hits = np.cumsum(hits)
        starts = starts[hits[starts + window - n + 1] > hits[starts]]
        keys = np.empty(len(starts), np.dtype([("h", np.uint64), ("c", np.uint16)]))
        keys["h"] = window_hashes(self.words, window)[starts]
        keys["c"] = (window_hashes(self.words, window, salt=2)[starts] >> U(48)).astype(np.uint16)
        order = np.lexsort((keys["c"], keys["h"]))
        by = keys[order]
        new = np.ones(len(by), bool)
        new[1:] = (by["h"][1:] != by["h"][:-1]) | (by["c"][1:] != by["c"][:-1])
        place = np.empty(len(by), np.int64)
        place[order] = np.cumsum(new) - 1
        distinct = by[new]
        return starts, distinct["h"].copy(), distinct["c"].copy(), place


def spread(keys: np.ndarray, shift: int, bits: int) -> list[tuple[int, int, int]]:
    """Bucket, start and end of the sorted keys' buckets."""
    buckets = (keys >> U(shift)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    edges = [0, *cuts.tolist(), len(keys)] if len(keys) else [0]
    return [(int(buckets[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def gathered(replies: list[tuple[int, int, bytes]], step: int, keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """One flag for each sorted key of a sheet, from the buckets' replies."""
    out = np.zeros(len(keys), bool)
    by_bucket = {b: x for s, b, x in replies if s == step}
    for bucket, a, b in spread(keys, shift, bits):
        if bucket in by_bucket:
            out[a:b] = np.unpackbits(np.frombuffer(by_bucket[bucket], np.uint8), count=b - a)
    return out


def probe(sheets: DataFrame, block: int, bits: int) -> DataFrame:
    """Step 1: which keys of each sheet are a block somewhere and in two documents or more."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Sheet(row["ids"], row["sizes"], row["data"])
                at, keys, place = s.anchors(block, bits)
                aligned, twice = s.flags(block, at, keys, place)
                rows = spread(keys, 32, bits)
                if rows:
                    low = keys.astype(np.uint32)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                            "sheet": pa.array([row["sheet"]] * len(rows), pa.int64()),
                            "keys": pa.array([low[x:y].tobytes() for _, x, y in rows], pa.binary()),
                            "aligned": pa.array([np.packbits(aligned[x:y]).tobytes() for _, x, y in rows], pa.binary()),
                            "twice": pa.array([np.packbits(twice[x:y]).tobytes() for _, x, y in rows], pa.binary()),
                        }
                    )

    def decide(table):
        parts = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        sizes = [len(p) for p in parts]
        flags = [np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(table[c].to_pylist(), sizes, strict=True)]).astype(bool) for c in ("aligned", "twice")]
        keys, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        aligned, shared = np.zeros(len(keys), bool), count > 1
        aligned[place[flags[0]]] = True
        shared[place[flags[1]]] = True
        hit = (aligned & shared)[place]
        return reply(table, 1, hit, sizes)

    sent = sheets.mapInArrow(send, "bucket int, sheet long, keys binary, aligned binary, twice binary")
    return sent.groupBy("bucket").applyInArrow(decide, REPLY)


def reply(table: pa.Table, step: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """Bits for each sheet that has a flag set."""
    ends = np.cumsum(sizes).tolist()
    rows = [(s, b, np.packbits(flags[x:y]).tobytes()) for s, b, x, y in zip(table["sheet"].to_pylist(), table["bucket"].to_pylist(), [0, *ends[:-1]], ends, strict=True) if flags[x:y].any()]
    return pa.table({"sheet": pa.array([r[0] for r in rows], pa.int64()), "step": pa.array([step] * len(rows), pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "bits": pa.array([r[2] for r in rows], pa.binary())})


def candidates(sheet: Sheet, window: int, bits: int, replies: list[tuple[int, int, bytes]]):
    """Windows around the hits that step 1 found in a sheet, as ``Sheet.repeats`` gives them."""
    at, keys, place = sheet.anchors(block_size(window), bits)
    return sheet.repeats(window, gathered(replies, 1, keys, 32, bits)[place], at)


def least_doc(sheet: Sheet, starts: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The smallest id that has each distinct key in the sheet."""
    least = np.full(n, NULL_ID)
    np.minimum.at(least, place, sheet.ids[sheet.doc[starts]])
    return least


def with_replies(replies: DataFrame, sheets: DataFrame, run, schema: str) -> DataFrame:
    """``run(row, replies)`` for every sheet, with the replies to it."""

    def both(key, left, right):
        got = list(zip(left["step"].to_pylist(), left["bucket"].to_pylist(), left["bits"].to_pylist(), strict=True))
        return pa.concat_tables([run(row, got) for row in right.to_pylist()])

    return replies.groupBy("sheet").cogroup(sheets.groupBy("sheet")).applyInArrow(both, schema)


SENT = "bucket int, sheet long, keys binary, checks binary, least binary"


def verify(sheets: DataFrame, replies: DataFrame, window: int, bits: int) -> DataFrame:
    """Step 2: which keys of each sheet an earlier document outside it has as well."""

    def send(row, got):
        s = Sheet(row["ids"], row["sizes"], row["data"])
        starts, high, check, place = candidates(s, window, bits, got)
        least = least_doc(s, starts, place, len(high))
        # ids as places in the sheet's sorted ids, which go along packed
        ids, where = np.unique(least, return_inverse=True)
        rows = spread(high, 64 - bits, bits)
        packer = zstandard.ZstdCompressor(level=1)
        small = np.uint16 if len(ids) < 1 << 16 else np.uint32

        def named(x, y):
            own, at = np.unique(where[x:y], return_inverse=True)
            head = np.array([len(own), np.dtype(small).itemsize], np.int64).tobytes()
            return packer.compress(head + np.diff(ids[own], prepend=0).tobytes() + at.astype(small).tobytes())

        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                "sheet": pa.array([row["sheet"]] * len(rows), pa.int64()),
                "keys": pa.array([high[x:y].tobytes() for _, x, y in rows], pa.binary()),
                "checks": pa.array([check[x:y].tobytes() for _, x, y in rows], pa.binary()),
                "least": pa.array([named(x, y) for _, x, y in rows], pa.binary()),
            }
        )

    def ids_of(data: bytes) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, width = np.frombuffer(raw[:16], np.int64).tolist()
        return np.cumsum(np.frombuffer(raw[16 : 16 + 8 * n], np.int64))[np.frombuffer(raw[16 + 8 * n :], f"<u{width}")]

    def decide(table):
        parts = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        sizes = [len(p) for p in parts]
        high = np.concatenate(parts)
        check = np.frombuffer(b"".join(table["checks"].to_pylist()), np.uint16)
        least = np.concatenate([ids_of(x) for x in table["least"].to_pylist()])
        order = np.lexsort((least, check, high))
        h, c = high[order], check[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.repeat(least[order][new], np.diff(np.append(np.flatnonzero(new), len(h))))
        earlier = np.zeros(len(h), bool)
        earlier[order] = first < least[order]
        return reply(table, 2, earlier, sizes)

    sent = with_replies(replies, sheets, send, SENT)
    return sent.groupBy("bucket").applyInArrow(decide, REPLY)


def covered(sheet: Sheet, window: int, bits: int, replies: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Which words of a sheet are in a window that a document with a smaller id has as well."""
    starts, high, _, place = candidates(sheet, window, bits, replies)
    earlier = gathered(replies, 2, high, 64 - bits, bits)
    least = least_doc(sheet, starts, place, len(high))
    gone = starts[earlier[place] | (least[place] < sheet.ids[sheet.doc[starts]])]
    depth = np.zeros(len(sheet.words) + 1, np.int64)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + window, -1)
    return np.cumsum(depth)[:-1] > 0


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decided(docs: DataFrame, id_col: str, text_col: str, window: int, sheet_bytes: int, carry: bool) -> tuple[DataFrame, DataFrame, int]:
    """The sheets, all replies to them and the number of bits of a bucket.

    Buckets are as many as there are partitions, and so many that one holds
    ``BUCKET`` bytes: the keys of step 1 are about twice the packed texts.
    """
    sheets = cut(pack_sheets(docs, id_col, text_col, sheet_bytes, carry))
    packed = sheets.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * packed // BUCKET)
    bits = min(30, max(4, least - 1).bit_length())
    first = cut(probe(sheets, block_size(window), bits))
    release(docs.sparkSession)
    second = cut(verify(sheets, first, window, bits))
    release(docs.sparkSession)
    return sheets, first.unionByName(second), bits


def kept_words(sheet: Sheet, mask: np.ndarray):
    """Of each document: its mask, how many words go, and the others joined (None if all stay)."""
    for text, first, n in zip(sheet.texts, sheet.first.tolist(), sheet.counts.tolist(), strict=True):
        own = mask[first : first + n]
        removed = int(own.sum())
        yield own, removed, b" ".join([w for w, gone in zip(text.split(), own.tolist(), strict=True) if not gone]) if removed else None


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, sheet_bytes: int = SHEET) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` and, if asked, ``kept`` per row of ``docs``.

    Words are what stands between spaces and 0x09 to 0x0D.  A word is removed
    if it is in a run of ``window`` words whose sequence also starts in a
    document with a smaller id; all runs are judged on the input.  ``spans``
    are the removed runs, as word numbers; ``kept`` is what is left, joined by
    single spaces, and ``kept_sha256`` its digest.

    Null and empty texts have no words.  Rows with equal ids do not remove
    from each other; a null id counts as 2^63 - 1, the largest, and null ids do
    not remove from each other.  Extra columns are ignored; an empty table gives
    no rows.  A sheet, and with it any single document, is looked at in one
    piece, in memory of 25 to 100 times its bytes.
    """
    sheets, replies, bits = decided(docs, id_col, text_col, window, sheet_bytes, carry=False)

    def finish(row, got):
        s = Sheet(row["ids"], row["sizes"], row["data"])
        out: tuple[list, ...] = ([], [], [], [])
        for text, (own, removed, kept) in zip(s.texts, kept_words(s, covered(s, window, bits, got)), strict=True):
            kept = b" ".join(text.split()) if kept is None else kept
            for column, v in zip(out, (removed, hashlib.sha256(kept).hexdigest(), spans_of(own) if removed else [], kept), strict=True):
                column.append(v)
        columns = {"doc_id": pa.array(s.ids, pa.int64(), mask=np.frombuffer(row["nulls"], bool)), "n_words": pa.array(s.counts, pa.int64()), "n_removed": pa.array(out[0], pa.int64()), "kept_sha256": pa.array(out[1], pa.string()), "spans": pa.array(out[2], SPAN)}
        return pa.table(columns | ({"kept": pa.array(out[3], pa.binary())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    done = with_replies(replies, sheets, finish, schema + (", kept binary" if with_text else ""))
    return done.withColumn("kept", F.col("kept").cast("string")) if with_text else done


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sheet_bytes: int = SHEET) -> DataFrame:
    """``docs`` with ``n_removed`` and ``kept``: what ``substring_dedup`` leaves of a text, the text itself if that is all of it.

    The other columns travel with the texts, so that nothing is joined back;
    they may have any names, but ``n_removed`` and ``kept`` are replaced.  Null
    and empty texts stay as they are; ids that are null or repeat are taken as
    by ``substring_dedup``.  An empty table gives no rows.
    """
    docs = docs.drop("n_removed", "kept")
    sheets, replies, bits = decided(docs, id_col, text_col, window, sheet_bytes, carry=True)
    others = [f for f in docs.schema if f.name != text_col]

    def finish(row, got):
        s = Sheet(row["ids"], row["sizes"], row["data"])
        found = list(kept_words(s, covered(s, window, bits, got)))
        table = from_stream(row["carried"])
        table = table.append_column("removed", pa.array([n for _, n, _ in found], pa.int64()))
        table = table.append_column("text", pa.array(s.texts, pa.binary()))
        return table.append_column("left", pa.array([k for _, _, k in found], pa.binary()))

    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(others)), "null boolean, removed long, text binary, left binary"])
    done = with_replies(replies, sheets, finish, schema)
    text = F.when(~F.col("null"), F.col("text").cast("string"))
    column = {f.name: F.col(f"c{k}") for k, f in enumerate(others)} | {text_col: text}
    return done.select(*(column[c].alias(c) for c in docs.columns), F.col("removed").alias("n_removed"), F.coalesce(F.col("left").cast("string"), text).alias("kept"))

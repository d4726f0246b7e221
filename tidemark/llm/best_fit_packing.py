"""Sum-of-squares packing of token sequences."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import cut, only, parts, text_rows

STEP = 1 << 20  # bytes of text looked at together
GROUP = 16_384  # pieces that one task packs, about


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length in the order given, and each bin's fill.

    N(g) is the number of open bins with g places left.  A length s goes where
    the sum of all N(g) squared becomes smallest: into a bin with gap g, which
    adds 2 (N(g - s) - N(g)) + 2, or into one that it fills, which adds
    1 - 2 N(s).  Ties go to the smallest gap.  Only if nothing fits a bin is opened.
    """
    open_, bins_by_gap = np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]
    never = np.int64(1) << 40
    held, bin_of, offset = [], np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        gaps = open_[s:]
        added = np.where(gaps > 0, 2 * (open_[: size - s + 1] - gaps) + 2, never)
        if gaps[0]:
            added[0] = 1 - 2 * gaps[0]
        g = int(added.argmin()) + s
        if added[g - s] >= never:
            b, g = len(held), size
            held.append(0)
        else:
            b = bins_by_gap[g].pop()
            open_[g] -= 1
        bin_of[k], offset[k] = b, size - g
        held[b] = size - g + s
        if g > s:
            open_[g - s] += 1
            bins_by_gap[g - s].append(b)
    return bin_of, offset, np.array(held, np.int64)


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: the longest go first."""
    order = np.argsort(-lengths, kind="stable")
    b, o, _ = sum_of_squares(lengths[order], size)
    bins, offsets = np.empty_like(b), np.empty_like(o)
    bins[order], offsets[order] = b, o
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and id 0, cut at ``size``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut_up(batches):
        only(word_bpe)
        table = word_bpe.packed(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, j, texts in parts(batch, STEP):
                split = [t.split() for t in texts]
                table.known(split)
                for doc, words in zip(ids[i:j], split, strict=True):
                    data = b"".join(map(table.__getitem__, words)) + b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(data), 4 * size)):
                        part = data[at : at + 4 * size]
                        for column, v in zip(out, (doc, p, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut_up, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Documents are cut only where they are longer than ``size``.  Pieces are
    dealt out into groups of about ``group``, each packed by the
    sum-of-squares rule in one task.  The sequences that are not full, of all
    groups together, are dealt anew and their pieces packed once more; a group
    keeps its sequences as they were where that does not save any.
    ``sequence_id`` is the group's number times 2^32 plus the place in the group.

    Null and empty texts are one piece of length 1 (id 0).  Null ids and
    repeated rows are packed like others; extra columns are ignored; an empty
    table gives no rows.
    """
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    cut_up = cut(pieces(docs, tokenizer, id_col, text_col, size))

    def groups(rows):
        return max(1, math.ceil(rows.count() / group))

    def pack(table):
        only(None)
        table = table.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        lengths, first = table["length"].to_numpy(), table["grp"][0].as_py() << 32
        bins, offsets = pack_lengths(lengths, size)
        loose = (np.bincount(bins, lengths) < size)[bins]
        added = {"sequence_id": pa.array(bins + first, pa.int64()), "offset": pa.array(offsets, pa.int64()), "loose": pa.array(loose)}
        for name, values in added.items():
            table = table.append_column(name, values)
        return table.drop_columns(["grp"])

    def pack_again(table):
        only(None)
        table = table.drop_columns(["grp", "loose"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        sequences = np.unique(table["sequence_id"].to_numpy())
        bins, offsets = pack_lengths(table["length"].to_numpy(), size)
        if bins.max() + 1 >= len(sequences):
            return table
        return table.drop_columns(["sequence_id", "offset"]).append_column("sequence_id", pa.array(sequences[bins])).append_column("offset", pa.array(offsets, pa.int64()))

    def dealt(rows, by):
        return rows.withColumn("grp", F.pmod(F.xxhash64(by), F.lit(groups(rows)))).groupBy("grp")

    # by the place in the checkpoint, so that equal rows spread as well
    packed = cut(dealt(cut_up, F.monotonically_increasing_id()).applyInArrow(pack, f"{columns}, loose boolean"))
    loose = packed.where("loose")
    return packed.where("not loose").drop("loose").unionByName(dealt(loose, "sequence_id").applyInArrow(pack_again, columns))

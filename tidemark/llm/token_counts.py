"""Token counts of whole texts under a public word-level BPE tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import only, parts, text_rows

STEP = 1 << 20  # bytes of text looked at together


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    Counts equal the library's for the whole text, without begin, end or added
    special tokens.  The white-space chunks of a text are counted through a
    table: pre-tokens proved to be whole tokens (``word_bpe.whole_tokens``)
    count as one, all others go through the merges once.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null ids
    give a row each; extra columns are ignored; an empty table gives none.
    """
    schema = "doc_id long, n_bytes long, n_tokens long"

    def count(batches):
        only(word_bpe)
        table = word_bpe.counts(tokenizer)
        for batch in batches:
            sizes, n = [], []
            for _, _, texts in parts(batch, STEP):
                split = [t.split() for t in texts]
                table.known(split)
                sizes += map(len, texts)
                n += [sum(map(table.__getitem__, s)) for s in split]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)

"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import best_fit_packing
from .exact_topk import exact_topk
from .line_dedup import line_dedup
from .media_columns import FIELDS, media_columns
from .near_dedup import near_dedup
from .sentence_pieces import round_trip
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity, train
from .warc import archive

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.concat_ws(";", F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["lines"], r["first_doc"], r["first_start"])))
    longest = F.coalesce(F.array_max(F.transform("runs", lambda r: r["lines"])), F.lit(0)).cast("long")
    digest = {"kept_sha256": F.sha2(F.col("kept").cast("binary"), 256), "n_runs": F.size("runs").cast("long"), "longest_run": longest, "runs_sha256": F.sha2(runs.cast("binary"), 256)}
    return found.select("doc_id", "n_lines", "n_removed", *(c.alias(k) for k, c in digest.items()))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).select(*FIELDS)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_media_columns": op7_media_columns,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_warc": op10_warc,
}
TOPK_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON c.r <> q.r WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

SUBSTRING_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM t),
k AS (SELECT *, CASE WHEN lead(p, 12) OVER (PARTITION BY doc_id ORDER BY p) IS NOT NULL
             THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS run FROM w),
h AS (SELECT doc_id, p, word, CAST(run IS NOT NULL AND min(doc_id) OVER (PARTITION BY run) < doc_id AS INTEGER) AS hit FROM k),
g AS (SELECT doc_id, p, word, max(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r USING (doc_id)
"""

NEAR_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
t AS (SELECT doc_id, list(line ORDER BY p) AS lines, list(i ORDER BY p) AS places FROM s GROUP BY doc_id),
v AS (SELECT doc_id, lines, places, w, unnest(range(0, len(lines) - w + 1)) AS p FROM t, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384]) AS w) WHERE w <= len(lines)),
f AS (SELECT doc_id, w, p, places, min((doc_id, p, places[p + 1])) OVER (PARTITION BY w, lines[p + 1:p + w]) AS first FROM v),
c AS (SELECT doc_id, w, p, places, first[1] AS fd, first[2] AS fp, first[3] AS fi FROM f WHERE first[1] <> doc_id OR first[2] <> p),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, w, fd, p - fp ORDER BY p) AS island FROM c),
r AS (SELECT doc_id, w, fd, min(p) AS p, count(*) + w - 1 AS n, min(fi) AS fi, any_value(places) AS places FROM g GROUP BY doc_id, w, fd, p - fp, island),
m AS (SELECT *, max(p + n) OVER (PARTITION BY doc_id ORDER BY p, n DESC, w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
x AS (SELECT * FROM m WHERE reached IS NULL OR p + n > reached),
y AS (SELECT DISTINCT doc_id, unnest(places[p + 1:p + n]) AS i FROM x),
z AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run, string_agg(places[p + 1] || ':' || n || ':' || fd || ':' || fi, ';' ORDER BY p) AS runs FROM x GROUP BY doc_id),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(y.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE y.i IS NULL), '') AS kept
      FROM l LEFT JOIN y ON y.doc_id = l.doc_id AND y.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256,
       coalesce(n_runs, 0) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(runs, '')) AS runs_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN z USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op4_exact_topk": TOPK_SQL, "op9_near_dedup": NEAR_SQL, "op10_warc": WARC_SQL}

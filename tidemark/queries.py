"""Registry of the queries over the shared tables and their SQL.

Each query is a function (spark, sf_dir) -> DataFrame; ``ORACLE_SQL`` holds the
same in DuckDB's SQL, where it can be said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grammar as g
from .operators import budgets, control, ordering, parsing, sinks
from .plans import sizing
from .sources import generate, text
from .streaming import batches

# Line sources, in SQL that both engines read.
PART = "SELECT p_partkey AS id, p_partkey || '. ' || p_name AS value FROM part"
CASED = "SELECT p_partkey AS id, p_partkey || '. ' || CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) ELSE p_name END AS value FROM part"
TIES = "SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN '00' ELSE '' END || CAST(p_partkey % 50 AS STRING) || '. ' || p_brand AS value FROM part"
MIXED = """SELECT o_orderkey AS id, CASE o_orderkey % 13
  WHEN 0 THEN '. ' || o_orderpriority
  WHEN 1 THEN o_orderkey || '.5 ' || o_orderpriority
  WHEN 2 THEN '-' || o_orderkey || '. ' || o_orderpriority
  WHEN 3 THEN '  ' || o_orderkey || ' . ' || o_orderpriority
  WHEN 4 THEN ''
  WHEN 5 THEN o_orderkey || o_orderpriority
  WHEN 6 THEN (2147483647 + o_orderkey) || '. ' || o_orderpriority
  WHEN 7 THEN '00' || o_orderkey || '. ' || o_orderpriority
  WHEN 8 THEN o_orderkey || '. '
  WHEN 9 THEN o_orderkey || '.5 2. ' || o_orderpriority
  ELSE o_orderkey || '. ' || o_orderpriority END AS value FROM orders"""
EVENTS = "SELECT event_id AS id, user_id || '. ' || event_type AS value FROM events"
ITEMS = "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey || '. ' || l_returnflag || ' ' || l_linestatus AS value, l_partkey, l_suppkey, l_extendedprice FROM lineitem"
TIE_ITEMS = ["id", "l_partkey", "l_suppkey", "l_extendedprice"]
SIZES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(pow(2, 10 + o_orderkey % 31) AS BIGINT) ELSE o_orderkey * 1048573 END AS requested,
  CASE WHEN o_orderkey % 5 = 0 THEN 10 * CAST(pow(2, 10 + o_orderkey % 41) AS BIGINT) ELSE o_orderkey * o_orderkey * 97 END AS file_size FROM orders"""

# What the oracles compute from a line source.
LENIENT = r"""SELECT *, coalesce(n, 0) AS number, CASE WHEN n IS NULL THEN value ELSE substr(value, p + 2) END AS key FROM
  (SELECT *, CASE WHEN p > 0 THEN try_cast(nullif(regexp_extract(substr(value, 1, p - 1), '^[ \t\n\x0B\f\r]*([+-]?[0-9]+)[ \t\n\x0B\f\r]*$', 1), '') AS INTEGER) END AS n FROM
    (SELECT *, instr(value, '. ') AS p FROM ({})))"""
STRICT = r"SELECT *, CASE WHEN number IS NOT NULL THEN substr(value, instr(value, '.') + 2) END AS key FROM (SELECT *, try_cast(nullif(regexp_extract(value, '^([0-9]+)\. ', 1), '') AS INTEGER) AS number FROM ({}))"
SPLIT = r"SELECT *, CASE WHEN number IS NOT NULL THEN regexp_extract(value, '(?s)^([0-9]+)\.[^ ]* (.*)$', 2) END AS key FROM (SELECT *, try_cast(nullif(regexp_extract(value, '(?s)^([0-9]+)\.[^ ]* (.*)$', 1), '') AS INTEGER) AS number FROM ({}))"
RANK = "SELECT id, value, number, key, row_number() OVER (ORDER BY key, number, value, id) AS pos FROM ({})"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A line source over the tables that it names."""
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders", "events", "lineitem", "documents") if f"FROM {t}" in sql}
    for t in found:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **found)


def query(sql: str | None = None):
    """Enter a function under its own name, with its oracle."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter


@query(RANK.format(LENIENT.format(PART)))
def total_sort(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, PART), ties=["id"])


@query(f"SELECT id, value, number, key FROM ({LENIENT.format(MIXED)})")
def parse_lenient(spark, sf_dir):
    return parsing.parse_lines(lines(spark, sf_dir, MIXED))


@query(f"SELECT id, value, number, key FROM ({STRICT.format(MIXED)}) WHERE number IS NOT NULL")
def parse_strict(spark, sf_dir):
    return parsing.parse_lines(lines(spark, sf_dir, MIXED), "strict")


@query(f"SELECT id, value, number, key FROM ({SPLIT.format(MIXED)})")
def parse_split_strict(spark, sf_dir):
    return parsing.parse_lines(lines(spark, sf_dir, MIXED), "split", on_error="keep")


@query(f"SELECT id, value FROM ({STRICT.format(MIXED)}) WHERE number IS NULL")
def rejected_lines(spark, sf_dir):
    return parsing.rejected_lines(lines(spark, sf_dir, MIXED))


@query(RANK.format(f"SELECT * FROM ({STRICT.format(MIXED)}) WHERE number IS NOT NULL"))
def strict_sort(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, MIXED), "strict", ties=["id"])


@query(RANK.format(LENIENT.format(MIXED)))
def lenient_sort(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, MIXED), ties=["id"])


@query(RANK.format(LENIENT.format(TIES)))
def sort_ties(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, TIES), ties=["id"])


@query(RANK.format(LENIENT.format(CASED)))
def case_sensitive_sort(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, CASED), ties=["id"])


EMPTY_KEYS = "SELECT o_orderkey AS id, o_orderkey || '. ' || CASE o_orderkey % 13 WHEN 8 THEN '' WHEN 10 THEN '' ELSE o_orderpriority END AS value FROM orders"
BLANKS = "SELECT o_orderkey AS id, CASE o_orderkey % 13 WHEN 4 THEN '' WHEN 11 THEN '   ' ELSE o_orderkey || '. ' || o_orderpriority END AS value FROM orders"


@query(RANK.format(LENIENT.format(EMPTY_KEYS)))
def empty_key_sort(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, EMPTY_KEYS), ties=["id"])


@query(RANK.format(LENIENT.format(BLANKS)))
def blank_lines_first(spark, sf_dir):
    return ordering.rank_lines(lines(spark, sf_dir, BLANKS), ties=["id"])


@query(f"SELECT id, value, number, key, row_number() OVER (ORDER BY key, number) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY key, number ORDER BY id) AS seen FROM ({LENIENT.format(EVENTS)})) WHERE seen = 1")
def sort_distinct(spark, sf_dir):
    distinct = ordering.first_seen(parsing.parse_lines(lines(spark, sf_dir, EVENTS)), "id")
    return ordering.number_rows(distinct, [F.col("key"), F.col("number")])


BATCHED = EVENTS.replace("SELECT ", "SELECT event_id // 1000 AS batch, ")


@query(f"SELECT batch, id, value, number, key, row_number() OVER (PARTITION BY batch ORDER BY key, number) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY batch, key, number ORDER BY id) AS seen FROM ({LENIENT.format(BATCHED)})) WHERE seen = 1")
def batch_sort(spark, sf_dir):
    source = lines(spark, sf_dir, EVENTS).withColumn("batch", g.whole_part(F.col("id"), 1000))
    return ordering.batch_sort(source, "batch", "id")


RUNS = f"SELECT *, id // 4096 AS run_idx FROM ({ITEMS})"
RUN_TIES = ", ".join(TIE_ITEMS)


LARGE_ID = 35_184_372_088_833  # beyond 2^45, and odd


@query(f"SELECT id + {LARGE_ID} AS id, value, (id + {LARGE_ID}) // 4096 AS run_idx FROM ({ITEMS})")
def assign_runs(spark, sf_dir):
    far = lines(spark, sf_dir, ITEMS).withColumn("id", F.col("id") + LARGE_ID)
    return ordering.assign_runs(far, "id", 4096).select("id", "value", "run_idx")


@query(f"SELECT run_idx, id, value, key, number, row_number() OVER (PARTITION BY run_idx ORDER BY key, number, value, {RUN_TIES}) AS pos FROM ({LENIENT.format(RUNS)})")
def sorted_runs(spark, sf_dir):
    runs = ordering.assign_runs(lines(spark, sf_dir, ITEMS), "id", 4096)
    return ordering.sorted_runs(runs, TIE_ITEMS).select("run_idx", "id", "value", "key", "number", "pos")


MERGED = "SELECT run_idx, id, value, key, number, row_number() OVER (ORDER BY key, number, run_idx, value, {}) AS pos FROM ({})"


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs merged, with the place of every line."""
    order = [F.col(c) for c in ("key", "number", "run_idx", "value", *TIE_ITEMS)]
    return ordering.number_rows(ordering.merge_runs(runs, TIE_ITEMS), order).select("run_idx", "id", "value", "key", "number", "pos")


@query(MERGED.format(RUN_TIES, LENIENT.format(RUNS)))
def merge_runs(spark, sf_dir):
    parsed = parsing.parse_lines(ordering.assign_runs(lines(spark, sf_dir, ITEMS), "id", 4096))
    return merged([parsed])


@query(MERGED.format(RUN_TIES, LENIENT.format(f"SELECT *, id % 2 AS run_idx FROM ({ITEMS})")))
def merge_two_runs(spark, sf_dir):
    parsed = parsing.parse_lines(lines(spark, sf_dir, ITEMS))
    return merged([parsed.where(F.col("id") % 2 == i) for i in (0, 1)])


PAIRS = f"SELECT a.id AS id, a.value AS left_line, b.value AS right_line FROM ({MIXED}) a JOIN ({MIXED}) b ON b.id = a.id + 1"
LEFT = "SELECT id, value AS left_line, key AS lk, number AS ln FROM ({})"
RIGHT = "SELECT id - 1 AS id, value AS right_line, key AS rk, number AS rn FROM ({})"


@query(f"SELECT id, left_line, right_line, CASE WHEN lk < rk THEN -1 WHEN lk > rk THEN 1 ELSE CAST(sign(ln - rn) AS INTEGER) END AS sign FROM ({LEFT.format(LENIENT.format(MIXED))}) JOIN ({RIGHT.format(LENIENT.format(MIXED))}) USING (id)")
def compare_lines(spark, sf_dir):
    return ordering.compare_lines(lines(spark, sf_dir, PAIRS), "left_line", "right_line")


EQUAL = "SELECT id, value, value = CAST(id % 50 AS STRING) || '. ' || key AS same FROM ({})"


@query(EQUAL.format(LENIENT.format(TIES)))
def content_equality(spark, sf_dir):
    parsed = parsing.parse_lines(lines(spark, sf_dir, TIES))
    return parsed.select("id", "value", (F.col("value") == g.format_line(F.col("id") % 50, F.col("key"))).alias("same"))


DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents"


def document_lines(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))


@query(f"SELECT doc_id, count(*) AS n_lines FROM ({DOC_LINES}) GROUP BY doc_id")
def count_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"SELECT doc_id, CAST(sum(strlen(value) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(value) + 1) AS BIGINT) AS n_chars FROM ({DOC_LINES}) GROUP BY doc_id")
def line_bytes(spark, sf_dir):
    value = F.col("value")
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(g.line_bytes(value)).alias("n_bytes"), F.sum(g.line_chars(value)).alias("n_chars"))


BEFORE = "coalesce(sum(strlen(value) + 1) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"SELECT id, value FROM (SELECT *, {BEFORE} AS b FROM ({PART})) WHERE b < 20000")
def byte_budget_cut(spark, sf_dir):
    return budgets.byte_budget_cut(lines(spark, sf_dir, PART), "id", 20_000, block=256)


@query(f"SELECT id, value FROM (SELECT *, {BEFORE.replace('strlen', 'length')} AS b FROM ({PART})) WHERE b + length(value) + 1 <= 20000")
def char_budget_cut(spark, sf_dir):
    return budgets.char_budget_cut(lines(spark, sf_dir, PART), "id", 20_000, block=256)


CHUNKS = f"SELECT id // 64 AS chunk, CAST(sum(strlen(value) + 1) AS BIGINT) AS size FROM ({PART}) GROUP BY 1"


@query(f"SELECT chunk, size, CAST(coalesce(sum(size) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM ({CHUNKS})")
def chunk_offsets(spark, sf_dir):
    sized = lines(spark, sf_dir, PART).groupBy(g.whole_part(F.col("id"), 64).alias("chunk")).agg(F.sum(g.line_bytes(F.col("value"))).alias("size"))
    return budgets.chunk_offsets(sized, "chunk", "size")


POWER = "CAST(pow(2, ceil(log2(CAST({} AS DOUBLE)))) AS BIGINT)"
MOST = "greatest(file_size // 10, 65536)"
TIERED = f"CASE WHEN file_size > 107374182400 THEN least(file_size // 50, 26214400) WHEN file_size > 53687091200 THEN least(file_size // 20, 52428800) ELSE {MOST} END"


@query(f"SELECT id, {POWER.format(f'least(greatest(requested, 65536), {TIERED})')} AS buffer, {POWER.format(f'least(greatest(requested, 65536), {MOST})')} AS parallel_buffer FROM ({SIZES})")
def buffer_plan(spark, sf_dir):
    requested, size = F.col("requested"), F.col("file_size")
    return lines(spark, sf_dir, SIZES).select("id", sizing.buffer_size(requested, size).alias("buffer"), sizing.buffer_size(requested, size, parallel=True).alias("parallel_buffer"))


@query(f"SELECT id, greatest(1000, requested // 200) AS lines_per_chunk, CASE WHEN id <= 10 THEN greatest(1, id) ELSE least(greatest(greatest(100, requested // 200), id // 16), least(requested // 100, id)) END AS parallel_lines, (file_size + 104857599) // 104857600 AS chunks FROM ({SIZES})")
def chunk_plan(spark, sf_dir):
    requested, size, n = F.col("requested"), F.col("file_size"), F.col("id")
    return lines(spark, sf_dir, SIZES).select("id", sizing.lines_per_chunk(requested).alias("lines_per_chunk"), sizing.lines_per_parallel_chunk(requested, n, 8).alias("parallel_lines"), sizing.chunk_count(size, 100 << 20).alias("chunks"))


PASSES = "CASE {} END"


@query(
    "SELECT o_orderkey AS id, CAST("
    + PASSES.format("WHEN o_orderkey <= 1 THEN 0 " + " ".join(f"WHEN o_orderkey <= {10**k} THEN {k}" for k in range(1, 12)))
    + " AS INTEGER) AS passes, CAST("
    + PASSES.format("WHEN o_orderkey <= 1 THEN 0 " + " ".join(f"WHEN o_orderkey <= {2**k} THEN {k}" for k in range(1, 40)))
    + " AS INTEGER) AS two_way_passes FROM orders"
)
def merge_passes(spark, sf_dir):
    n = F.col("id")
    return lines(spark, sf_dir, SIZES).select("id", sizing.merge_passes(n).alias("passes"), sizing.merge_passes(n, 2).alias("two_way_passes"))


@query(f"SELECT id, greatest(1, least(1000, requested // 50)) AS batch FROM ({SIZES})")
def batch_plan(spark, sf_dir):
    return lines(spark, sf_dir, SIZES).select("id", sizing.batch_lines(F.lit(1000).cast("long"), F.col("requested")).alias("batch"))


@query("SELECT i AS chunk, i * 104857600 AS \"offset\", least(104857600, 10737418340 - i * 104857600) AS size FROM range(103) r(i)")
def generator_chunk_plan(spark, sf_dir):
    return generate.chunk_plan(spark, 10_737_418_340, 100 << 20)


@query(f"SELECT id, instr(value, '.') + 1 AS key_start, length(value) - instr(value, '.') - 1 AS key_length, substr(value, instr(value, '.') + 2) AS key FROM ({STRICT.format(MIXED)}) WHERE number IS NOT NULL")
def key_slice(spark, sf_dir):
    """Where the key of a line starts and how long it is, and the slice."""
    start, length = g.key_slice(F.col("value"))
    sized = parsing.parse_lines(lines(spark, sf_dir, MIXED), "strict").select("id", "value", start.alias("key_start"), length.alias("key_length"))
    return sized.select("id", "key_start", "key_length", g.sliced(F.col("value"), F.col("key_start"), F.col("key_length")).alias("key"))


@query(f"SELECT run_idx, min(struct_pack(key := key, number := number, id := id)).id AS id, count(*) AS n_lines FROM ({LENIENT.format(RUNS)}) GROUP BY run_idx")
def run_heads(spark, sf_dir):
    """The least line of each run."""
    return ordering.run_heads(parsing.parse_lines(ordering.assign_runs(lines(spark, sf_dir, ITEMS), "id", 4096)), ["id"])


WORD_SQL = "['" + "', '".join(generate.WORDS) + "']"


def drawn(id_, seed, what):
    """Draws that SQL can say."""
    return id_ * (7919 if what == "number" else 31) + seed


GENERATED = f"""
WITH l AS (SELECT i // {{most}} AS chunk, i % {{most}} AS place, i AS id, (i // {{most}}) * {{chunk}} AS since, least({{chunk}}, 300000 - (i // {{most}}) * {{chunk}}) AS size FROM range({{most}} * {{chunks}}) r(i)),
n AS (SELECT *, {{number}} || '. ' || ({WORD_SQL})[(id * 31 + 5) % 16 + 1] AS value FROM l),
b AS (SELECT *, coalesce(sum(strlen(value) + 1) OVER (PARTITION BY chunk ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT chunk, place, value FROM b WHERE {{fits}}"""
RANDOM = "((id * 7919 + 5) % 999999 + 1 + since // 50)"
SHORTEST = min(map(len, generate.WORDS)) + 4


def generated_sql(chunk: int, number: str, fits: str) -> str:
    """What a generator makes of 300,000 bytes; a chunk's ids start behind as many as it could hold at most."""
    return GENERATED.format(most=-(-chunk // SHORTEST), chunks=-(-300_000 // chunk), chunk=chunk, number=number, fits=fits)


@query(generated_sql(300_000, RANDOM, "before < size"))
def generate_lines(spark, sf_dir):
    return generate.generator("basic", seed=5, draw=drawn, block=1 << 12)(spark, 300_000)


@query(generated_sql(300_000, RANDOM, "before < size"))
def generate_batched(spark, sf_dir):
    return generate.generator("batched", seed=5, draw=drawn, block=1 << 10)(spark, 300_000)


@query(generated_sql(64_000, RANDOM, "before < size"))
def generate_parallel(spark, sf_dir):
    return generate.generator("parallel", seed=5, draw=drawn, chunk_bytes=64_000)(spark, 300_000)


@query(generated_sql(64_000, "(place + 1 + since // 50)", "before + strlen(value) + 1 <= size"))
def generate_chunk_buffer(spark, sf_dir):
    return generate.generator("chunk_buffer", seed=5, draw=drawn, chunk_bytes=64_000, block=1 << 8)(spark, 300_000)


@query("SELECT CAST(1 AS BOOLEAN) AS within_one_line, CAST(0 AS BIGINT) AS bad_lines")
def generator_format_check(spark, sf_dir):
    target = 1 << 20
    made = generate.generate_lines(spark, target, seed=7)
    number, key = g.strict_number(F.col("value")), g.strict_key(F.col("value"))
    good = number.between(1, generate.LARGEST) & key.isin(*generate.WORDS)
    found = made.agg(F.sum(g.line_bytes(F.col("value"))).alias("size"), F.max(g.line_bytes(F.col("value"))).alias("line"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad_lines"))
    return found.select((F.col("size").between(target, target + F.col("line") - 1)).alias("within_one_line"), "bad_lines")


@query(f"SELECT id, value FROM ({PART})")
def strip_cr(spark, sf_dir):
    with_cr = lines(spark, sf_dir, PART).withColumn("value", F.concat("value", F.when(F.col("id") % 2 == 0, "\r").otherwise("")))
    return with_cr.withColumn("value", g.strip_cr(F.col("value")))


@query(f"SELECT id, value, CAST(id % 2 AS INTEGER) AS chunk_idx FROM ({PART})")
def concat_chunks(spark, sf_dir):
    part = lines(spark, sf_dir, PART)
    return ordering.concat_chunks([part.where(F.col("id") % 2 == i) for i in (0, 1)])


RANKED_PART = f"SELECT value, row_number() OVER (ORDER BY key, number, value, id) AS line_no FROM ({LENIENT.format(PART)})"


def read_back(lines: DataFrame) -> DataFrame:
    """Checkpointed, so that the files it was read from can go."""
    ordering.checkpoint_folder(lines.sparkSession)
    return lines.checkpoint()


@query(RANKED_PART)
def text_roundtrip(spark, sf_dir):
    """Sorted lines written as text and read back in file order."""
    with sinks.scratch(spark, "roundtrip") as path:
        sinks.write_lines(ordering.sort_lines(lines(spark, sf_dir, PART), ties=["id"]), path)
        return read_back(text.read_numbered_lines(spark, path))


@query(RANKED_PART)
def single_file_roundtrip(spark, sf_dir):
    """The same as one file."""
    with sinks.scratch(spark, "single") as path:
        sinks.write_single_file(ordering.sort_lines(lines(spark, sf_dir, PART), ties=["id"]), f"{path}/all.txt")
        return read_back(text.read_numbered_lines(spark, f"{path}/all.txt"))


@query(f"SELECT run_idx, value, row_number() OVER (ORDER BY key, number, run_idx, value) AS pos FROM ({LENIENT.format(f'SELECT *, id // 100 AS run_idx FROM ({PART})')})")
def merge_run_files(spark, sf_dir):
    """Runs written as a sorted file each, read back and merged."""
    with sinks.scratch(spark, "runs") as path:
        runs = parsing.parse_lines(ordering.assign_runs(lines(spark, sf_dir, PART), "id", 100))
        sinks.write_runs(runs, path)
        back = parsing.parse_lines(text.read_runs(spark, path).select("value", "run_idx"))
        order = [F.col(c) for c in ("key", "number", "run_idx", "value")]
        return read_back(ordering.number_rows(ordering.merge_runs([back]), order).select("run_idx", "value", "pos"))


@query(f"SELECT replace(value, ' ', chr(13)) AS value FROM ({PART})")
def newline_only_lines(spark, sf_dir):
    """Lines with carriage returns inside and one at the end, cut at newlines alone."""
    odd = lines(spark, sf_dir, PART).select(F.concat(F.translate("value", " ", "\r"), F.lit("\r")).alias("value"))
    with sinks.scratch(spark, "newlines") as path:
        sinks.write_lines(odd, path)
        return read_back(text.read_lines(spark, path, newline_only=True))


@query(f"SELECT id, CASE WHEN id % 7 > 0 THEN value END AS value FROM ({PART})")
def length_guard(spark, sf_dir):
    """Lines that are checked for their length, nulls among them."""
    some = lines(spark, sf_dir, PART).withColumn("value", F.when(F.col("id") % 7 > 0, F.col("value")))
    return parsing.check_length(some, 200)


@query(f"SELECT id, value, number, key FROM ({STRICT.format(PART)})")
def fail_fast(spark, sf_dir):
    """Lines of which a malformed one would fail the job."""
    return parsing.parse_lines(lines(spark, sf_dir, PART), "strict", on_error="raise")


@query(f"SELECT count(*) AS lines, count(*) FILTER (WHERE number IS NULL) AS rejected, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes FROM ({STRICT.format(MIXED)})")
def observed_counts(spark, sf_dir):
    """What an observation has counted while the lines were parsed."""
    parsed, seen = control.observed_parse(lines(spark, sf_dir, MIXED), "strict")
    parsed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("lines", "rejected", "bytes"))], "lines long, rejected long, bytes long")


BY_NUMBER = f"SELECT *, row_number() OVER (PARTITION BY number % 100 ORDER BY id) AS seen FROM ({LENIENT.format(EVENTS)})"


@query(f"SELECT id, value, number, key, row_number() OVER (ORDER BY number % 100 DESC) AS pos FROM ({BY_NUMBER}) WHERE seen = 1")
def distinct_by_own_order(spark, sf_dir):
    """Lines that are distinct and in order by another comparison: the number's last two digits, downwards."""
    last = F.col("number") % 100
    distinct = ordering.first_seen(parsing.parse_lines(lines(spark, sf_dir, EVENTS)), "id", same_by=[last])
    return ordering.number_rows(distinct, [last.desc()])


UTF16 = "array_to_string(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN printf('%04X', unicode(c)) ELSE printf('%04X%04X', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')"
ASTRAL = "SELECT doc_id, CASE length(value) % 5 WHEN 0 THEN chr(128512) || value WHEN 1 THEN chr(65518) || value ELSE value END AS value FROM ({})"


@query(f"SELECT doc_id, value, number, key, row_number() OVER (ORDER BY {UTF16}, number, value, doc_id) AS pos FROM ({LENIENT.format(ASTRAL.format(DOC_LINES))})")
def utf16_sort(spark, sf_dir):
    """Document lines, some with astral characters, in the order of UTF-16 code units."""
    size = F.char_length("value") % 5
    first = F.when(size == 0, "\U0001f600").when(size == 1, "\uffee").otherwise("")
    source = document_lines(spark, sf_dir).select("doc_id", F.concat(first, "value").alias("value"))
    return ordering.rank_lines(source, ties=["doc_id"], utf16=True)


@query(f"SELECT value FROM (SELECT value, row_number() OVER (PARTITION BY id // 1000, key, number ORDER BY id) AS seen FROM ({LENIENT.format(EVENTS)})) WHERE seen = 1")
def streaming_batch_sort(spark, sf_dir):
    """Event lines written as a text file for each thousand and sorted by a stream, a file a batch."""
    with sinks.scratch(spark, "stream") as base:
        source = lines(spark, sf_dir, EVENTS).withColumn("file", g.whole_part(F.col("id"), 1000))
        source.repartition("file").sortWithinPartitions("file", "id").select("value", "file").write.partitionBy("file").text(f"{base}/in")
        batches.batch_sort_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
        return read_back(spark.read.text(f"{base}/out").select("value"))

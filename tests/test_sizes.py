"""Planners, budgets, generators, sinks and the stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grammar as g
from tidemark.operators import budgets, sinks
from tidemark.plans import sizing
from tidemark.sources import generate, text
from tidemark.streaming import batches

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
SIZES = [0, 64 * KB, MB, GB, 3 * GB, 30 * GB, 60 * GB, 200 * GB]


def model_buffer(requested, size, parallel):
    requested = max(requested, 64 * KB)
    if not parallel and size > 100 * GB:
        most = min(size // 50, 25 * MB)
    elif not parallel and size > 50 * GB:
        most = min(size // 20, 50 * MB)
    else:
        most = max(size // 10, 64 * KB)
    return 1 << (min(requested, most) - 1).bit_length()


@pytest.mark.parametrize("parallel", [False, True])
def test_buffer_size(spark, parallel):
    cases = [(r, s) for r in (1, 64 * KB, 64 * KB + 1, 100_000, MB, 10 * MB, 3 * GB, *(1 << k for k in range(20, 60))) for s in (*SIZES, 10 << 29, 10 << 31, 10 << 39, (10 << 39) + 10)]
    df = spark.createDataFrame(cases, "r long, s long")
    got = [x.b for x in df.select(sizing.buffer_size(F.col("r"), F.col("s"), parallel).alias("b")).collect()]
    assert got == [model_buffer(r, s, parallel) for r, s in cases]


def test_lines_per_chunk(spark):
    cases = [(b, n) for b in (64 * KB, MB, 10 * MB) for n in (0, 1, 10, 11, 5_000, 10**6, 10**8)]

    def model(b, n, t):
        return max(1, n) if n <= 10 else min(max(max(100, b // 200), n // (2 * t)), min(b // 100, n))

    df = spark.createDataFrame(cases, "b long, n long")
    got = df.select(sizing.lines_per_chunk(F.col("b")).alias("one"), sizing.lines_per_parallel_chunk(F.col("b"), F.col("n"), 4).alias("many")).collect()
    assert [(r.one, r.many) for r in got] == [(max(1000, b // 200), model(b, n, 4)) for b, n in cases]


def test_merge_passes(spark):
    counts = [0, 1, 2, 10, 11, 100, 101, 1000, 1001, 2**40]
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    got = df.select(sizing.merge_passes(F.col("n")).alias("ten"), sizing.merge_passes(F.col("n"), 2).alias("two")).collect()

    def model(n, ways):
        passes = 0
        while n > 1:
            n, passes = -(-n // ways), passes + 1
        return passes

    assert [(r.ten, r.two) for r in got] == [(model(n, 10), model(n, 2)) for n in counts]


def test_chunk_plan(spark):
    rows = [tuple(r) for r in generate.chunk_plan(spark, 250, 100).collect()]
    assert rows == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    large = generate.chunk_plan(spark, 5 << 40, 1 << 30).agg(F.min("offset"), F.sum("size")).first()
    assert tuple(large) == (0, 5 << 40)
    assert spark.range(1).select(sizing.batch_lines(F.lit(1000).cast("long"), F.lit(200).cast("long")).alias("n")).first().n == 4


def total(df):
    return df.agg(F.sum(g.line_bytes(F.col("value"))).alias("n")).first().n or 0


@pytest.mark.parametrize("target", [1, 100, 2048, 1 << 20])
@pytest.mark.parametrize("kind", generate.KINDS)
def test_generators_keep_the_budget(spark, target, kind):
    """Of the whole, and of every chunk by itself."""
    for chunk in (None, 50_000):
        df = generate.generator(kind, seed=3, **({"chunk_bytes": chunk} if chunk else {}))(spark, target)
        sizes = {r.chunk: r.n for r in df.groupBy("chunk").agg(F.sum(g.line_bytes(F.col("value"))).alias("n")).collect()}
        longest = max(len(w) for w in generate.WORDS) + 10
        for k in range(-(-target // (chunk or target))):
            size = min(chunk or target, target - k * (chunk or target))
            if generate.KINDS[kind].get("exceed", True):
                assert size <= sizes[k] < size + longest
            else:
                assert size - longest < sizes.get(k, 0) <= size


def test_chunks_shift_their_numbers(spark):
    """By a fiftieth of where they start, in 64 bits."""
    first = {k: [r.value for r in generate.generator(k, chunk_bytes=5_000)(spark, 12_000).where("place = 0").orderBy("chunk").collect()] for k in ("chunk_buffer", "parallel")}
    assert [int(v.partition(".")[0]) for v in first["chunk_buffer"]] == [1, 101, 201]
    far = spark.range(1).select(generate.random_number(F.lit(5), 1, 50 << 40).alias("far"), generate.random_number(F.lit(5), 1).alias("near")).first()
    assert far.far - far.near == 1 << 40


def test_generated_lines_are_well_formed(spark):
    words = ["quartz", "a vein of ore", "Slate", "石"]
    df = generate.generate_lines(spark, 2048, words, seed=1)
    bad = df.where(~(g.strict_number(F.col("value")).between(1, generate.LARGEST) & g.strict_key(F.col("value")).isin(words)))
    assert df.count() > 0 and bad.count() == 0


def test_generator_is_reproducible(spark):
    a, b, c = (generate.generate_lines(spark, 4096, seed=s).orderBy("place").collect() for s in (1, 1, 2))
    assert a == b and a != c
    numbers = [r.value.partition(".")[0] for r in generate.generate_lines(spark, 500, numbers="sequential", exceed=False).orderBy("place").collect()]
    assert numbers == [str(i + 1) for i in range(len(numbers))]


@pytest.mark.parametrize("arguments", [{"target_bytes": 0}, {"target_bytes": 5, "words": []}, {"target_bytes": 5, "words": ["a", ""]}, {"target_bytes": 5, "numbers": "odd"}])
def test_generator_arguments(spark, arguments):
    with pytest.raises(ValueError):
        generate.generate_lines(spark, **arguments)


def test_budgets_across_blocks(spark):
    df = spark.range(1000).withColumn("value", F.lit("x" * 9))
    assert budgets.byte_budget_cut(df, "id", 1234, block=7).count() == 124
    assert budgets.char_budget_cut(df, "id", 1234, block=7).count() == 123
    for target in (1, 10, 70, 71, 490, 491, 9_999, 10_000, 10_001):  # at and around ends of blocks
        assert budgets.byte_budget_cut(df, "id", target, block=7).count() == min(1000, -(-target // 10))
        assert budgets.char_budget_cut(df, "id", target, block=7).count() == min(1000, target // 10)


def test_disk_check(tmp_path):
    assert not sizing.disk_is_short(str(tmp_path), 1)
    assert sizing.disk_is_short(str(tmp_path), 1 << 60)


def test_write_lines(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("b",), ("a",)], "value string")
    sinks.write_lines(df.orderBy("value"), out)
    sinks.write_lines(df.orderBy("value"), out)
    assert [r.value for r in text.read_numbered_lines(spark, out).orderBy("line_no").collect()] == ["a", "b"]
    for write in (sinks.write_lines, sinks.write_single_file):
        with pytest.raises(ValueError):
            write(df, " ")
    bad = df.withColumn("value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        sinks.write_single_file(bad, str(tmp_path / "bad.txt"))
    assert [p.name for p in tmp_path.iterdir() if "bad" in p.name] == []
    with pytest.raises(KeyError), sinks.scratch(spark, "test") as path:
        sinks.write_lines(df, path)
        assert spark.read.text(path).count() == 2
        raise KeyError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.text(path)
    sinks.write_single_file(df.where("false"), str(tmp_path / "empty.txt"))
    assert (tmp_path / "empty.txt").read_bytes() == b""


def test_stream_sorts_each_file_and_runs_again_without_harm(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("2. A\n1. A\n02. A\n")
    start = lambda: batches.batch_sort_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    start()
    (tmp_path / "in/b.txt").write_text("9. Z\n1. A\n")
    start()
    start()
    got = {}
    for r in spark.read.text(str(tmp_path / "out")).select("batch", "value").collect():
        got.setdefault(r.batch, []).append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == {0: ["1. A", "2. A"], 1: ["1. A", "9. Z"]}


def test_stream_sorts_many_batches_in_one_trigger(spark, tmp_path):
    """Each file is a batch by itself and numbered by time through all triggers; a trigger that failed runs again without harm."""
    source, out, state = (tmp_path / x for x in ("in", "out", "state"))
    source.mkdir()
    rng, made = random.Random(3), {}

    def arrive(names, n=40):
        for k, name in enumerate(names):
            made[name] = [f"{rng.choice(['', '0'])}{rng.randrange(20)}. {rng.choice('pqr')}" for _ in range(n)]
            (source / name).write_text("".join(x + "\n" for x in made[name]))
            os.utime(source / name, (len(made) + 1e9, len(made) + 1e9))

    def sort(**options):
        batches.batch_sort_stream(spark, str(source), str(out), str(state), **options).awaitTermination()
        return [p.name for p in sorted((state / "commits").glob("[0-9]*"))]

    def found():
        folders = {int(p.name.partition("=")[2]): p for p in out.glob("batch=*")}
        return {k: "".join(f.read_text() for f in sorted(p.glob("part-*"))).splitlines() for k, p in folders.items()}

    def plainly(*names):
        first = {}
        for line in (x for name in sorted(names) for x in made[name]):  # by path, as the lines of a batch are seen
            first.setdefault((line.partition(". ")[2], int(line.partition(". ")[0])), line)
        return [first[x] for x in sorted(first)]

    early = [f"{k * 7 % 23:02} é%.txt" for k in range(23)]
    arrive(early)
    assert sort() == ["0"]  # one trigger, not one a file
    assert found() == {k: plainly(name) for k, name in enumerate(early)}
    late = ["z.txt", "a.txt", "m.txt", "c.txt", "b.txt"]
    arrive(late)
    assert sort(files_per_batch=2, batches_per_trigger=2) == ["0", "1", "2"]
    expected = {k: plainly(name) for k, name in enumerate(early)} | {23: plainly("z.txt", "a.txt"), 24: plainly("m.txt", "c.txt"), 25: plainly("b.txt")}
    assert found() == expected
    for p in (*(state / "commits").glob("*2*"), *(out / "batch=25").glob(".part-*")):
        p.unlink()  # as if the last trigger had failed while it wrote
    for p in (out / "batch=25").glob("part-*"):
        p.write_text("half a ba")
    assert sort(files_per_batch=2, batches_per_trigger=2) == ["0", "1", "2"]
    assert found() == expected
    arrive(["empty.txt"], 0)
    sort()
    arrive(["last.txt"])
    sort()
    assert found() == expected | {26: plainly("last.txt")}

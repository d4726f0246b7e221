"""Sorting: worked examples, ties, runs, batches, places."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grammar as g
from tidemark.operators import ordering, sinks
from tidemark.operators.parsing import parse_lines
from tidemark.sources import text

TEXTS = ["kite", "Kite", "KITE", "otter in the reeds", "otter", "", "zebu", "birch. bark", "2. pine", "  spaced"]


def made(seed: int, n: int, texts=TEXTS, largest: int = 10**6) -> list[str]:
    rng = random.Random(seed)
    return [f"{rng.randrange(1, largest)}. {rng.choice(texts)}" for _ in range(n)]


def plainly(lines: list[str]) -> list[str]:
    """Sorted by the text's bytes, then by the number, then by the line."""
    return sorted(lines, key=lambda x: (x.partition(". ")[2].encode(), int(x.partition(". ")[0]), x))


CASES = {
    "mixed": made(1, 200),
    "one_line": made(2, 1),
    "no_line": [],
    "one_text": made(3, 30, ["heron"], 100),
    "one_number": [f"77. {t}" for t in ("sedge", "reed", "Rush", "moss")],
    "wide_numbers": [f"{n}. delta" for n in (2_147_483_647, 3, 70_000_001, 12, 999)],
    "no_texts_among_others": made(4, 40, ["", "fern"]),
    "upper_and_lower": made(5, 40, ["elm", "ELM", "Elm", "eLm", "eLM"]),
    "in_order": plainly(made(6, 50)),
    "backwards": plainly(made(7, 50))[::-1],
    "repeated": made(8, 20, ["lark", "wren"], 3),
}


def frame(spark, lines, name="value"):
    return spark.createDataFrame([(x,) for x in lines], f"{name} string")


def values(df):
    return [r.value for r in df.collect()]


@pytest.mark.parametrize("grammar", ["lenient", "strict"])
@pytest.mark.parametrize("name", CASES)
def test_sorts_equal_a_plain_sort(spark, name, grammar):
    assert values(ordering.sort_lines(frame(spark, CASES[name]), grammar)) == plainly(CASES[name])


@pytest.mark.parametrize("name", CASES)
def test_sorts_through_files(spark, tmp_path, name):
    (tmp_path / "in.txt").write_text("".join(x + "\n" for x in CASES[name]))
    out = str(tmp_path / "out.txt")
    sinks.write_single_file(ordering.sort_lines(text.read_lines(spark, str(tmp_path / "in.txt"))), out)
    assert open(out).read() == "".join(x + "\n" for x in plainly(CASES[name]))
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_blank_lines_come_first(spark):
    assert values(ordering.sort_lines(frame(spark, ["4. gorse", "\t", "3. heath", ""]))) == ["", "\t", "4. gorse", "3. heath"]


def test_compare(spark):
    rng = random.Random(9)
    lines = made(10, 40, ["teal", "Teal", "swan"], 4)
    pairs = [(a, b) for a in lines for b in rng.sample(lines, 3)] + [("007. teal", "7. teal"), ("-2147483648. teal", "2147483647. teal")]
    split = lambda x: (x.partition(". ")[2], int(x.partition(". ")[0]))
    expected = [(a, b, (split(a) > split(b)) - (split(a) < split(b))) for a, b in pairs]
    df = spark.createDataFrame(expected, "left string, right string, expected int")
    assert {e for _, _, e in expected} == {-1, 0, 1}
    assert all(r.sign == r.expected for r in ordering.compare_lines(df).collect())


def test_equal_keys_of_different_text(spark):
    df = spark.createDataFrame([(0, "1. A"), (1, "01. A"), (2, "1. A")], "id long, value string")
    assert values(ordering.sort_lines(df, ties=["id"])) == ["01. A", "1. A", "1. A"]
    assert values(ordering.sort_distinct(df, "id")) == ["1. A"]


def test_many_runs_equal_a_plain_sort(spark, tmp_path):
    rng = random.Random(5)
    lines = [f"{rng.randrange(10**6)}. {rng.choice('abcdefgh') * rng.randrange(1, 4)}" for _ in range(50_000)]
    (tmp_path / "in.txt").write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = ordering.rank_lines(text.read_lines(spark, str(tmp_path / "in.txt")))
        assert found.rdd.getNumPartitions() > 1
        got = [r.value for r in found.orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    split = lambda x: (x.partition(". ")[2], int(x.partition(". ")[0]), x)
    assert got == sorted(lines, key=split)


def test_places_are_dense_even_with_a_hot_key(spark):
    df = spark.range(3_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("7. hot")).otherwise(F.concat("id", F.lit(". cold"))).alias("value"))
    ranks = [r.pos for r in ordering.rank_lines(df, ties=["id"]).collect()]
    assert sorted(ranks) == list(range(1, 3_001))


def test_batches_are_sorted_and_distinct_by_themselves(spark):
    df = spark.createDataFrame([(0, 0, "2. A"), (0, 1, "1. A"), (0, 2, "2. A"), (1, 3, "1. A")], "batch long, id long, value string")
    got = [(r.batch, r.pos, r.value) for r in ordering.batch_sort(df, "batch", "id").orderBy("batch", "pos").collect()]
    assert got == [(0, 1, "1. A"), (0, 2, "2. A"), (1, 1, "1. A")]


def test_first_seen_takes_the_first(spark):
    df = spark.createDataFrame([(5, "1. A"), (3, "01. A"), (9, "001. A")], "id long, value string")
    assert values(ordering.first_seen(parse_lines(df), "id")) == ["01. A"]


def test_merge_gives_ties_to_the_lower_run(spark):
    runs = [parse_lines(frame(spark, x)) for x in (["1. B", "3. B"], ["1. A", "1. B"])]
    assert [(r.value, r.run_idx) for r in ordering.merge_runs(runs).collect()] == [("1. A", 1), ("1. B", 0), ("1. B", 1), ("3. B", 0)]


def test_utf16_order(spark):
    keys = ["\U0001f600", "﻿z", "￮", "a", "A"]
    df = frame(spark, [f"1. {k}" for k in keys])
    assert [r.key for r in ordering.sort_lines(df).collect()] == ["A", "a", "﻿z", "￮", "\U0001f600"]
    assert [r.key for r in ordering.sort_lines(df, utf16=True).collect()] == ["A", "a", "\U0001f600", "﻿z", "￮"]


def test_own_sort_columns(spark):
    df = frame(spark, ["1. B", "3. A", "2. C"])
    assert values(ordering.sort_lines(df, order_by=[F.col("number").desc()])) == ["3. A", "2. C", "1. B"]


def test_own_order_in_every_sort(spark):
    """Lines that compare equal by the columns given are one line, and runs and batches follow them."""
    df = spark.createDataFrame([(0, 0, "1. bb"), (0, 1, "2. a"), (0, 2, "31. cc"), (1, 3, "5. d")], "batch long, id long, value string")
    own = {"order_by": [F.length("key").desc()], "same_by": [F.length("key")]}
    assert values(ordering.sort_distinct(df, "id", **own)) == ["1. bb", "2. a"]
    assert [(r.batch, r.pos, r.value) for r in ordering.batch_sort(df, "batch", "id", **own).orderBy("batch", "pos").collect()] == [(0, 1, "1. bb"), (0, 2, "2. a"), (1, 1, "5. d")]
    runs = ordering.assign_runs(df, "id", 2)
    assert [r.value for r in ordering.sorted_runs(runs, order_by=[F.col("number").desc()]).orderBy("run_idx", "pos").collect()] == ["2. a", "1. bb", "31. cc", "5. d"]
    merged = ordering.merge_runs([parse_lines(runs.drop("batch", "id"))], order_by=[F.col("number").desc()])
    assert values(merged) == ["31. cc", "5. d", "2. a", "1. bb"]


def test_run_numbers_beyond_32_bits(spark):
    df = spark.createDataFrame([(1 << 45, "a"), ((1 << 60) + 4097, "b"), (4095, "c")], "id long, value string")
    assert [r.run_idx for r in ordering.assign_runs(df, "id", 4096).collect()] == [1 << 33, (1 << 48) + 1, 0]


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(2, "1. b", 7, 8, 9, 10), (1, "1. a", 7, 8, 9, 10)], "id long, value string, part int, row int, start int, first int")
    df = df.withColumnsRenamed({"part": "_part", "row": "row", "start": "_start", "first": "_first"})
    ranked = ordering.rank_lines(df)
    assert sorted(tuple(r[c] for c in ("id", "pos", "_part", "row", "_start", "_first")) for r in ranked.collect()) == [(1, 1, 7, 8, 9, 10), (2, 2, 7, 8, 9, 10)]
    assert ordering.first_seen(parse_lines(df), "id").columns == [*df.columns, "number", "key"]


def test_a_file_for_each_run(spark, tmp_path):
    lines = made(12, 90)
    runs = parse_lines(ordering.assign_runs(spark.createDataFrame(list(enumerate(lines)), "id long, value string"), "id", 30))
    sinks.write_runs(runs, str(tmp_path / "runs"))
    files = sorted((tmp_path / "runs").glob("run_idx=*/part-*"))
    assert [f.read_text().splitlines() for f in files] == [plainly(lines[k : k + 30]) for k in (0, 30, 60)]
    back = parse_lines(text.read_runs(spark, str(tmp_path / "runs")).select("value", "run_idx"))
    assert values(ordering.merge_runs([back])) == plainly(lines)


def test_numbered_lines_of_many_pieces(spark, tmp_path):
    lines = made(13, 20_000)
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("".join(x + "\n" for x in lines[k * 10_000 : (k + 1) * 10_000]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        numbered = text.read_numbered_lines(spark, str(tmp_path))
        assert [(r.line_no, r.value) for r in numbered.orderBy("line_no").collect()] == list(enumerate(lines, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_format_line(spark):
    assert spark.range(1).select(g.format_line(F.lit(0), F.lit("x")).alias("v")).first().v == "0. x"

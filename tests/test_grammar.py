"""The three grammars, rejects and what files may hold."""

import pytest
from pyspark.errors import AnalysisException

from tidemark.operators import parsing
from tidemark.sources import text

# line, lenient, split, strict
MATRIX = [
    ("415. Apple", (415, "Apple"), (415, "Apple"), (415, "Apple")),
    ("1. ", (1, ""), (1, ""), (1, "")),
    ("1.", (0, "1."), None, None),
    ("1. A. B", (1, "A. B"), (1, "A. B"), (1, "A. B")),
    ("1.  two", (1, " two"), (1, " two"), (1, " two")),
    ("1.5 foo", (0, "1.5 foo"), (1, "foo"), None),
    ("1.5 foo. bar", (0, "1.5 foo. bar"), (1, "foo. bar"), None),
    (". x", (0, ". x"), None, None),
    ("-3. Neg", (-3, "Neg"), None, None),
    ("+3. Pos", (3, "Pos"), None, None),
    (" 7. Sp", (7, "Sp"), None, None),
    (" 8. Nb", (8, "Nb"), None, None),
    ("2147483648. Big", (0, "2147483648. Big"), None, None),
    ("2147483647. Max", (2147483647, "Max"), (2147483647, "Max"), (2147483647, "Max")),
    ("007. Z", (7, "Z"), (7, "Z"), (7, "Z")),
    ("", (0, ""), None, None),
    ("   ", (0, "   "), None, None),
    ("﻿1. A", (0, "﻿1. A"), None, None),
    ("1. a b", (1, "a b"), (1, "a b"), (1, "a b")),
    ("x. 1. y", (0, "x. 1. y"), None, None),
]


@pytest.mark.parametrize(("grammar", "column"), [("lenient", 1), ("split", 2), ("strict", 3)])
def test_matrix(spark, grammar, column):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(MATRIX)], "id int, value string")
    got = {r.id: None if r.number is None else (r.number, r.key) for r in parsing.parse_lines(df, grammar, on_error="keep").collect()}
    assert got == {i: row[column] for i, row in enumerate(MATRIX)}


def test_only_the_bad_line_is_dropped(spark):
    df = spark.createDataFrame([("1. A",), ("1.5 B",), ("2. C",)], "value string")
    assert [r.value for r in parsing.parse_lines(df, "strict").collect()] == ["1. A", "2. C"]
    assert [r.value for r in parsing.rejected_lines(df).collect()] == ["1.5 B"]


def test_raise_names_the_line(spark):
    df = spark.createDataFrame([("1. A",), ("1.5 B",)], "value string")
    with pytest.raises(Exception, match="Malformed line: 1.5 B"):
        parsing.parse_lines(df, "strict", on_error="raise").collect()


def test_null_lines(spark):
    df = spark.createDataFrame([(None,), ("1. A",)], "value string")
    assert parsing.parse_lines(df, "lenient").count() == 1
    assert parsing.parse_lines(df, "strict").count() == 1


def test_too_long_a_line(spark):
    df = spark.createDataFrame([("1. A",), ("1. ABCDEFGH",)], "value string")
    assert parsing.check_length(df, 20).count() == 2
    with pytest.raises(Exception, match="line too long"):
        parsing.check_length(df, 5).collect()


def test_unknown_arguments(spark):
    df = spark.createDataFrame([("1. A",)], "value string")
    with pytest.raises(ValueError):
        parsing.parse_lines(df, "loose")


def read(spark, tmp_path, data, **options):
    (tmp_path / "in.txt").write_bytes(data)
    return [r.value for r in text.read_lines(spark, str(tmp_path / "in.txt"), **options).collect()]


def test_line_ends(spark, tmp_path):
    assert read(spark, tmp_path, b"2. B\n1. A") == ["2. B", "1. A"]
    assert read(spark, tmp_path, b"2. B\r\n1. A\r\n") == ["2. B", "1. A"]
    assert read(spark, tmp_path, b"1. A\rB\n") == ["1. A", "B"]
    assert read(spark, tmp_path, b"1. A\rB\r\n\n", newline_only=True) == ["1. A\rB", ""]


def test_byte_order_marks(spark, tmp_path):
    assert read(spark, tmp_path, b"\xef\xbb\xbf1. A\n\xef\xbb\xbf2. B\n") == ["1. A", "﻿2. B"]


def test_invalid_utf8(spark, tmp_path):
    assert read(spark, tmp_path, b"1. A\xff\xfeB\n") == ["1. A��B"]


def test_missing_file(spark, tmp_path):
    with pytest.raises(AnalysisException):
        text.read_lines(spark, str(tmp_path / "none"))


def test_empty_file_and_count(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"")
    assert text.count_lines(text.read_lines(spark, str(tmp_path / "in.txt"))) == 0


def test_numbered_lines_and_runs(spark, tmp_path):
    for name, body in (("a", "x\ny\n"), ("b", "z\n")):
        (tmp_path / f"{name}.txt").write_text(body)
    got = text.read_numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r.line_no, r.value) for r in got) == [(1, "x"), (2, "y"), (3, "z")]
    runs = text.read_runs(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert runs.select("run").distinct().count() == 2

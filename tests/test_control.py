import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import control
from tidemark.operators.parsing import check_length
from tidemark.sources import text


def test_counts_come_with_the_action(spark):
    df = spark.createDataFrame([("1. A",), ("x",), ("2. BB",)], "value string")
    parsed, seen = control.observed_parse(df)
    assert parsed.count() == 2
    assert seen.get == {"lines": 3, "rejected": 1, "bytes": 5 + 2 + 6}


def test_cancelled_jobs_fail(spark):
    def later():
        time.sleep(1.5)
        control.cancel(spark, "sort-7")

    thread = threading.Thread(target=later)
    with control.cancellable(spark, "sort-7"):
        thread.start()
        with pytest.raises(Exception, match="(?i)cancel|interrupt"):
            spark.range(0, 1 << 35, 1, 2).agg(F.sum(F.hash("id"))).collect()
    thread.join()
    assert spark.range(3).count() == 3


def test_a_buffer_sets_what_a_task_reads(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1. x\n" * 40_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: text.read_lines(spark, str(tmp_path / "in.txt")).rdd.getNumPartitions()
    with control.buffered(spark, 20_000):
        assert read() >= 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before and read() < 10
    with pytest.raises(ValueError), control.buffered(spark, 0):
        pass


def test_null_lines_have_no_length(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",)], "value string")
    assert check_length(df, 3).count() == 3
    with pytest.raises(Exception, match="too long"):
        check_length(df, 2).count()

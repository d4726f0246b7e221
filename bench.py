"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the queries over the shared tables it generates a text file of
$BENCH_TEXT_MB megabytes (default 256) and sorts it to another file, which is the
three runs after one that warms up.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark import queries  # noqa: E402
from tidemark.operators import ordering, sinks  # noqa: E402
from tidemark.sources import generate, text  # noqa: E402

HEADLINE = ["total_sort", "lenient_sort", "strict_sort", "sort_distinct", "batch_sort", "sorted_runs", "merge_runs", "parse_lenient", "count_lines", "byte_budget_cut"]
RUNS = 3


def timed(f) -> float:
    f()
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        f()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    megabytes = int(os.environ.get("BENCH_TEXT_MB", "256"))
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{folder}/checkpoint")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        taken = {name: timed(lambda name=name: queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
        made, out = f"{folder}/made", f"{folder}/sorted"
        taken["generate_text"] = timed(lambda: sinks.write_lines(generate.generate_lines(spark, megabytes << 20), made))
        taken["sort_text"] = timed(lambda: sinks.write_lines(ordering.sort_lines(text.read_lines(spark, made), "strict"), out))
        size = sum(e.stat().st_size for e in os.scandir(made) if e.name.startswith("part-"))
        lines = spark.read.text(made).count()
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "text_bytes": size, "text_lines": lines, "sort_mib_per_s": round(size / 2**20 / taken["sort_text"], 1), "runs": RUNS, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()

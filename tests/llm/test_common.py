"""The helpers that the corpus operators share."""

import gc
import time
from pathlib import Path

from tidemark.llm import common
from tidemark.llm.common import cut, release


def test_release_gives_back_what_the_jvm_has_freed(spark):
    """Freed buffers between such as are still held, so that the allocator keeps them by itself."""
    jvm, pid = spark._jvm, spark.sparkContext._gateway.proc.pid

    def resident():
        return next(int(x.split()[1]) for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) / 1024

    buffers, held = jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for i in range(3000):
        buffer = jvm.java.nio.ByteBuffer.allocateDirect(100_000)  # filled with zeros
        (held if i % 30 == 0 else buffers).add(buffer)
    del buffers, buffer
    for _ in range(8):  # the buffers go and the heap has its size before release() is called
        gc.collect()
        jvm.System.gc()
        time.sleep(0.3)
    before = resident()
    release(spark)
    assert before - resident() > 50
    assert held.size() == 100


def test_a_cut_gives_memory_back_only_after_a_while(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", calls.append)
    monkeypatch.setattr(common, "_released", time.monotonic(), raising=False)
    assert cut(spark.range(9)).count() == 9 and not calls
    monkeypatch.setattr(common, "_released", time.monotonic() - 60, raising=False)
    assert cut(spark.range(9)).count() == 9 and calls == [spark]

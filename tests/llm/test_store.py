"""Tables that operators write on the way."""

import re
import threading
from pathlib import Path

import pytest

from tagloom.llm.store import finished, give_back_heaps, materialise


def test_operators_side_by_side(spark):
    """Each thread deletes its own tables only, however their operators interleave."""
    begun, go_on, found = threading.Barrier(2), threading.Barrier(2), {}

    def operator(name):
        first = materialise(spark.range(100).withColumnRenamed("id", name), name)
        begun.wait(60)
        second = materialise(first.where(f"{name} < 50"), name)
        go_on.wait(60)
        return second.unionByName(first)

    def run(name):
        found[name] = finished(lambda: operator(name), name).count()

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found == {"a": 150, "b": 150}


def test_inner_tables_go(spark):
    """What is written on the way is deleted, also that of an operator inside another."""
    seen = []

    def inner():
        seen.append(materialise(spark.range(5), "inner"))
        return seen[0]

    def outer():
        seen.append(finished(inner, "middle"))
        return seen[1].unionByName(seen[1])

    made = finished(outer, "outer")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [path(f).getFileSystem(conf).exists(path(f)) for t in seen for f in t.inputFiles()]
    assert made.count() == 10 and not any(there)


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's own figures")
def test_driver_gives_memory_back(spark):
    """Memory that the driver's JVM has freed, below some that it still holds, goes back when a table is written."""
    field = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    spans = [unsafe.allocateMemory(120_000) for _ in range(1500)]  # too small to be mapped alone
    for at in spans:
        unsafe.setMemory(at, 120_000, 1)
    for at in spans[::2] + spans[1:-1:2]:
        unsafe.freeMemory(at)
    before = held()
    materialise(spark.range(5), "small")
    after = held()
    unsafe.freeMemory(spans[-1])
    assert before - after > 100, (before, after)


def test_executors_give_their_heap_back(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = whole()
    give_back_heaps(spark)
    assert whole() > before

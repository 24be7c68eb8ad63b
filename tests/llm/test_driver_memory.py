"""The driver gives freed memory back while an operator writes its tables."""

from pathlib import Path

from sparkloom.llm import runtime


def test_a_written_table_returns_what_the_jvm_freed_outside_its_heap(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(status.read_text().split("VmRSS:")[1].split()[0]) / 1024
    table = spark.range(10)
    runtime.drop(runtime.written(table, "first"))
    monkeypatch.setattr(runtime, "_TABLES", [0])  # the next table doesn't collect garbage
    begun = resident()
    buffers = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    full = resident()
    for i, x in enumerate(buffers):
        if i % 50:  # the others hold the allocator's top
            x.end()
    runtime.drop(runtime.written(table, "second"))
    assert full - begun > 100 and full - resident() > 0.6 * (full - begun)
    for x in buffers[::50]:
        x.end()

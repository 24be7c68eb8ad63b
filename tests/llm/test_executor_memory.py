"""The executors' garbage is collected while an operator writes its tables, and when a scope ends."""

from sparkloom.llm import runtime


def test_executors_are_swept_between_tables_and_after_a_scope(spark, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Copy" not in b.getName() and "Scavenge" not in b.getName())
    monkeypatch.setattr(runtime, "executors", lambda spark: 3, raising=False)  # as if the session had them; here all are one JVM
    monkeypatch.setattr(runtime, "SWEEP", 1000)  # the driver's own sweeps don't count
    monkeypatch.setattr(runtime, "_TABLES", [0])
    with runtime.scope():
        begun = count()
        for _ in range(6):
            runtime.written(spark.range(3), "some")
        during = count()
    assert during - begun >= 3 and count() - during >= 3


def test_a_local_session_has_no_executors_to_sweep(spark):
    assert runtime.executors(spark) == 0

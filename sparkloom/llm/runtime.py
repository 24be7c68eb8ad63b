"""What the operators share: the shared work folder, written tables, and shipping the code to executors."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Tables between two sweeps of the driver, and of the executors; tables written so far.
SWEEP, SWEEP_ALL, _TABLES = 3, 6, [0]
_SCOPE: contextvars.ContextVar[tuple] = contextvars.ContextVar("tables", default=())


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; without it only a local session has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, bloom: str | None = None, outer: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and a lost executor costs nothing but a reread.

    bloom: a column for which the files get Bloom filters. outer: the table outlives the scope() around it.
    """
    path = work_dir(df.sparkSession, name)
    short_plans(df.sparkSession)
    (df.write.option(f"parquet.bloom.filter.enabled#{bloom}", "true") if bloom else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    _sweep(df.sparkSession)
    scopes = _SCOPE.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(out)
    return out


def _sweep(spark: SparkSession) -> None:
    """After every SWEEP tables, collects the driver's garbage: only then does Spark remove the shuffle files and broadcasts of
    queries that are over, on all machines; the driver's heap stays small as well. After every table the driver's JVM gives back
    what it freed outside its heap, as give_back() does for Python: many small queries, compiled by hundreds of threads, leave
    some hundred MB in their allocator.
    """
    _TABLES[0] += 1
    jvm = spark.sparkContext._jvm
    if _TABLES[0] % SWEEP == 0:
        gc.collect()
        jvm.System.gc()
    trim(spark)
    if _TABLES[0] % SWEEP_ALL == 0:
        sweep_executors(spark)


def executors(spark: SparkSession) -> int:
    """Executors besides the driver; none in a local session."""
    return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1


def sweep_executors(spark: SparkSession) -> None:
    """Collects the garbage of the executors' JVMs, by one short task for each: they give back the heap that an earlier stage grew and
    the classes compiled for it, which otherwise stay for the life of the application beside the Python workers. Where Spark doesn't let a query
    call Java, nothing happens.
    """
    n = executors(spark)
    if n > 0:
        with contextlib.suppress(PySparkException, Py4JError):
            spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def trim(spark: SparkSession) -> None:
    """Lets the allocator of the driver's JVM return free memory to the system; on a JVM without this command nothing happens."""
    jvm, array, named = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array, spark.sparkContext._jvm.java.lang.Class.forName
    types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[i] = named(kind)
    with contextlib.suppress(Py4JError):
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by reflection on the interface, since the server's own class is not open to callers
        named("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


@contextlib.contextmanager
def scope():
    """Drops what written() made inside when it ends, and sweeps the executors: for callers that have written or collected a result by then."""
    made: list[DataFrame] = []
    token = _SCOPE.set((*_SCOPE.get(), made))
    try:
        yield made
    finally:
        _SCOPE.reset(token)
        drop(*made)
        if made:
            sweep_executors(made[0].sparkSession)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written_at", None)
        if path:
            df._written_at = None
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Characters of a plan's description: Spark writes one for every query and every change of its plan.
DESCRIPTION = 1 << 14


def short_plans(spark: SparkSession) -> None:
    """Long expressions in many small queries make descriptions that fill the driver's heap: they are cut, unless a limit is set."""
    key = "spark.sql.maxPlanStringLength"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > 1 << 24:
        spark.conf.set(key, str(DESCRIPTION))


#: Bytes of a batch between the JVM and Python: both sides hold some of them per task.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application, and sees to small batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, None) or "0").rstrip("b") or 0) not in range(1, BATCH + 1):
        spark.conf.set(key, str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that gives memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

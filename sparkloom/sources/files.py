"""CSV, text, JSON, Parquet, ORC, LibSVM and JDBC sources and sinks, and tables made from queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; without it only a local session has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def version(spark: SparkSession, path: str) -> str:
    """A name for a table's data as it is now: its path and the time of its last change."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    return f"{path}@{status.getModificationTime()}:{status.getLen()}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, executors may be lost."""
    path = folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False, sep: str = ",", quote: str = '"', escape: str = "\\", null_value: str = "", where: str | None = None) -> DataFrame:
    """COPY FROM: text with a declared schema; where filters while loading."""
    rows = spark.read.schema(schema).options(header=header, sep=sep, quote=quote, escape=escape, nullValue=null_value).csv(path)
    return rows.where(where) if where else rows


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",", quote: str = '"', escape: str = "\\", null_value: str = "", mode: str = "error") -> None:
    """COPY TO."""
    df.write.mode(mode).options(header=header, sep=sep, quote=quote, escape=escape, nullValue=null_value).csv(path)


def through_csv(df: DataFrame, **options) -> DataFrame:
    path = folder(df.sparkSession, "csv")
    write_csv(df, path, **options)
    return read_csv(df.sparkSession, path, df.schema, **options)


def with_defaults(df: DataFrame, marker: str, defaults: dict[str, object]) -> DataFrame:
    """COPY's DEFAULT marker: text columns that hold it take the column's default."""
    return df.withColumns({c: F.when(F.col(c) == marker, F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def create_table_as(df: DataFrame, name: str, with_data: bool = True) -> DataFrame:
    """CREATE TABLE AS: a new file-backed table each time; a temp view of that name reads it."""
    path = folder(df.sparkSession, name)
    (df if with_data else df.limit(0)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.createOrReplaceTempView(name)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options) -> DataFrame:
    """A remote table; with a partition column it is read by `parts` tasks. Filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def libsvm_lines(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """`label id:value …` lines of the non-zero features."""
    parts = [F.when(F.col(c) != 0, F.concat(F.lit(f"{i}:"), F.format_number(F.col(c), "0.####"))) for i, c in enumerate(features, 1)]
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), *parts).alias("line"))


def parse_libsvm(lines: DataFrame, column: str, fields: int) -> DataFrame:
    """label, ids and values, zero-padded to `fields`; entries without a value have the value 1."""
    parts = F.split(F.col(column), " ")
    entries = F.slice(parts, 2, fields)
    pad = lambda x, zero: F.concat(x, F.array_repeat(zero, F.greatest(F.lit(fields) - F.size(x), F.lit(0))))
    ids = F.transform(entries, lambda e: F.split(e, ":")[0].cast("int"))
    values = F.transform(entries, lambda e: F.coalesce(F.get(F.split(e, ":"), F.lit(1)).cast("double"), F.lit(1.0)))
    return lines.select(parts[0].cast("double").alias("label"), pad(ids, F.lit(0)).alias("ids"), pad(values, F.lit(0.0)).alias("values"))


def import_foreign_schema(spark: SparkSession, url: str, schema: str, only: list[str] | None = None, prefix: str = "", **options) -> list[str]:
    """IMPORT FOREIGN SCHEMA: a view over each table of a remote schema (or of those named); the views' names."""
    jvm = spark.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        found, names = connection.getMetaData().getTables(None, schema, "%", None), []
        while found.next():
            if found.getString("TABLE_TYPE") in ("TABLE", "VIEW"):
                names.append(found.getString("TABLE_NAME"))
    finally:
        connection.close()
    made = []
    for name in sorted(names):
        if only is None or name.lower() in [o.lower() for o in only]:
            view = f"{prefix}{name.lower()}"
            read_jdbc(spark, url, f"{schema}.{name}", **options).createOrReplaceTempView(view)
            made.append(view)
    return made


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """row and values of the matrices in .npy files: a task reads a file, which holds as much as a task may."""
    import io

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                m = np.load(io.BytesIO(data.as_py()), allow_pickle=False).astype(np.float64)
                m = m.reshape(len(m), -1)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, m.shape[1]), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), values], names=["row", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row long, values array<double>")

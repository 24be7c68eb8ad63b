"""Streams over folders of Parquet files; every query has a batch twin in plans/streams.py."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.files import folder


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp, with or without a time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet file or folder at path, so many files a batch (the back-pressure)."""
    schema = spark.read.parquet(path).schema
    parent, name = os.path.split(path.rstrip("/"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(path) if spark.read.format("binaryFile").load(path).select("path").where(~F.endswith("path", F.lit("/" + name))).limit(1).count() else reader.option("pathGlobFilter", name).load(parent)
    # event time must be a timestamp; without a time zone it is taken in the session's
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over all there is, into the shared folder, and reads the result."""
    spark = out.sparkSession
    path, state = folder(spark, "stream"), folder(spark, "stream-state")
    if mode == "append":
        query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        put = lambda df, _: df.write.mode("overwrite").parquet(path)  # noqa: E731  complete mode: each batch has the whole result
        query = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(seconds("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(seconds("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", seconds("session_window.start").alias("start"), "n")


def latest(changes: DataFrame, keys: list[str], at: str, op: str = "op") -> DataFrame:
    """A change feed applied: each key's last change, unless it is a delete. Partial before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    out = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(*keys, "r.*")
    return out.where(F.col(op) != "D")


def train_by_batch(events: DataFrame, step: Callable[[DataFrame, int], None]) -> None:
    """Calls step with each micro-batch; back-pressure comes from the source's files per batch."""
    state = folder(events.sparkSession, "stream-state")
    events.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def gaps(events: DataFrame, key: str, at: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(at)
    return events.withColumn("gap", F.col(at).cast("long") - F.lag(F.col(at).cast("long")).over(w))

"""Sessions and the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def get_spark(app: str = "sparkloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; on a cluster use the cluster's own session."""
    cores = cores or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def register_tables(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = TABLES) -> None:
    """Temp views over the Parquet tables of a folder."""
    for name in only:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

"""The registry of named queries and of their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import TABLES, register_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tables_in(sql: str) -> tuple[str, ...]:
    return tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql))


def sql(name: str, text: str, oracle: str | None = None, rows_only: bool = False) -> None:
    """A query given as Spark SQL. The oracle is the same text unless another is given; rows_only: there is none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir, tables_in(text))
        return spark.sql(text)

    QUERIES[name] = run
    if not rows_only:
        ORACLE_SQL[name] = oracle or text


def query(name: str, oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its oracle where SQL can express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

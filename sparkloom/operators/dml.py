"""INSERT, UPDATE and DELETE with RETURNING, ON CONFLICT, and materialised views, over tables of Parquet snapshots.

A change is a new snapshot of the table; what is returned are the rows that were inserted, updated (new values) or deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.files import folder


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The new table and the rows inserted; columns that rows lacks take their defaults, or null."""
    new = rows.select(*[(F.col(c) if c in rows.columns else (defaults or {}).get(c, F.lit(None))).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(new), new


def update(table: DataFrame, values: dict[str, Column], where: Column) -> tuple[DataFrame, DataFrame]:
    """The new table and the rows updated; a null condition leaves a row as it is."""
    changed = lambda c: values[c].cast(table.schema[c].dataType) if c in values else F.col(c)
    new = table.select(*[F.when(_true(where), changed(c)).otherwise(F.col(c)).alias(c) for c in table.columns])
    return new, table.where(_true(where)).select(*[changed(c).alias(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """The new table and the rows deleted; a null condition keeps a row."""
    return table.where(~_true(where)), table.where(_true(where))


def insert_on_conflict(table: DataFrame, rows: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """INSERT … ON CONFLICT (keys): DO NOTHING, or DO UPDATE with values of `old.*` and `excluded.*`.

    Null keys conflict with nothing. Of inserted rows of one key, DO NOTHING keeps one; DO UPDATE refuses them.
    """
    own = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = W.partitionBy(*keys)
    numbered = own.where(whole).withColumn("__nth", F.row_number().over(w.orderBy(*[F.col(c).asc_nulls_last() for c in own.columns])))
    free = own.where(~whole)
    if update is not None:
        twice = F.raise_error(F.lit("ON CONFLICT DO UPDATE would change a row a second time"))
        numbered = numbered.withColumn("__nth", F.when(F.col("__nth") > 1, twice.cast("int")).otherwise(F.col("__nth")))
    one = numbered.where("__nth = 1").drop("__nth").alias("excluded")
    same = [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys]
    added = one.join(table.alias("old"), same, "left_anti").unionByName(free)
    if update is None:
        return table.unionByName(added), added
    values = [(update.get(c, F.col(f"old.{c}"))).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    changed = table.alias("old").join(one, same).select(*values)
    kept = table.alias("old").join(one, same, "left_anti")
    return kept.unionByName(changed).unionByName(added), changed.unionByName(added)


@dataclass
class MaterializedView:
    """A stored result that is made anew by refresh(); readers see the last complete one."""

    spark: SparkSession
    name: str
    make: Callable[[], DataFrame]
    version: int = 0

    def refresh(self, with_data: bool = True) -> DataFrame:
        """Computes the query into a new folder, then points the view's name at it: no reader sees half of it."""
        df = self.make()
        path = folder(self.spark, f"view-{self.name}-{self.version + 1}")
        (df if with_data else df.limit(0)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.createOrReplaceTempView(self.name)
        self.version += 1
        return out


def call(spark: SparkSession, steps: Sequence[str | Callable[[SparkSession], DataFrame | None]], **values) -> DataFrame | None:
    """A procedure: statements (with :named values) and Python steps in order; the last one's rows, if it has any."""
    out = None
    for s in steps:
        out = spark.sql(s, args={k: v for k, v in values.items() if f":{k}" in s}) if isinstance(s, str) else s(spark)
    return out

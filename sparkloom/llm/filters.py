"""Filters of fixed size over sets of keys, and joins whose hot keys are not shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Longs in a filter at least and at most: 4 Mbit, whatever the input. A full filter only lets more rows through to the join behind it.
LEAST_WORDS, FILTER_WORDS = 1 << 8, 1 << 16
#: A key is hot if it has more than one row in so many. There are fewer hot keys than that.
HOT = 256


def filter_size(keys: DataFrame) -> int:
    """Longs for 16 bits a key, within the bounds: the filter travels with every task that uses it."""
    return min(FILTER_WORDS, max(LEAST_WORDS, 1 << (keys.count() // 4).bit_length()))


class Filter:
    """A filter over keys[key]: its bits are written as one row, and travel as a scalar subquery."""

    def __init__(self, keys: DataFrame, key: str):
        self.size, spark = filter_size(keys), keys.sparkSession
        h = F.xxhash64(keys[key])
        set_bits = keys.select(F.pmod(h, F.lit(self.size)).cast("int").alias("i"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int").alias("b"))
        none = spark.range(self.size).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
        words = set_bits.select("i", F.expr("shiftleft(1L, b)").alias("w")).unionByName(none).groupBy("i").agg(F.bit_or("w").alias("w"))
        # `size` numbers, in order
        self.bits = written(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("bits")), "filter")

    def may_hold(self, probe: Column) -> Column:
        """True wherever probe is a key of the filter, and for few other rows."""
        p = F.xxhash64(probe)
        return F.getbit(F.get(self.bits.scalar(), F.pmod(p, F.lit(self.size)).cast("int")), F.pmod(F.shiftrightunsigned(p, 32), F.lit(64)).cast("int")) == 1


def maybe_in(keys: DataFrame, key: str, probe: Column) -> Column:
    """True wherever probe is one of keys[key], and for few other rows."""
    return Filter(keys, key).may_hold(probe)


def hot_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys with more than one row in HOT: fewer than HOT keys, whatever the input."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * HOT > rows.agg(F.count(F.lit(1)).alias("n")).scalar()).select(*keys)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | list | None = None) -> DataFrame:
    """rows joined (inner or left) with a table that has one row a key. Rows of hot keys meet the few table rows of those

    keys by a broadcast of fewer than HOT rows and stay where they are; only the others are dealt by key. No key is null.
    hot: the hot keys, if they are known, as a table or as what few() gives.
    """
    known = hot if isinstance(hot, list) else few(hot_keys(rows, *keys) if hot is None else hot, keys)
    if not known:
        return rows.join(table, keys, how)
    is_hot = F.col(keys[0]).isin(known) if len(keys) == 1 else reduce(Column.__or__, [reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in zip(keys, one, strict=True)]) for one in known])
    return rows.where(~is_hot).join(table.where(~is_hot), keys, how).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), keys, how))


def few(hot: DataFrame, keys: list[str]) -> list:
    """The values of a table of hot keys: fewer than HOT rows at the driver (a node's links count twice: 2 * HOT)."""
    rows = hot.select(*keys).collect()
    return [r[0] for r in rows] if len(keys) == 1 else [tuple(r) for r in rows]

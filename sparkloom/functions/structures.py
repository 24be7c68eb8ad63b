"""Arrays, maps, label trees and enums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_all(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def uniq(a: Column) -> Column:
    """Without an element equal to the one before it."""
    return F.filter(a, lambda x, i: (i == 0) | (x != F.element_at(a, F.greatest(i, F.lit(1)))))


def subpath(path: Column, start: int, length: int | None = None) -> Column:
    parts = F.split(path, r"\.")
    return F.array_join(F.slice(parts, F.lit(start + 1), F.lit(length) if length is not None else F.size(parts)), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b for label paths; a path is its own ancestor."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def lquery(path: Column, pattern: str) -> Column:
    """Label patterns: `*` any labels, `*{n}` n labels, `x*` a prefix, `a|b` alternatives, `!x` not."""
    out = "^"
    for label in pattern.split("."):
        if label == "*":
            out += r"(?:[^.]+\.)*"
        elif label.startswith("*{"):
            out += r"(?:[^.]+\.){" + label[2:-1] + "}"
        elif label.startswith("!"):
            out += rf"(?!(?:{label[1:]})\.)[^.]+\."
        else:
            out += "(?:" + "|".join(x[:-1] + "[^.]*" if x.endswith("*") else x for x in label.split("|")) + r")\."
    return F.concat(path, F.lit(".")).rlike(out + "$")


def enum_rank(c: Column, values: list[str]) -> Column:
    """The ordinal of an enum's label."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def connectby(edges: DataFrame, key: str, parent: str, start, depth: int = 0, delim: str = "~") -> DataFrame:
    """The tree below start: key, level and branch; one round a level, each written to the shared folder. 0: all levels."""
    from ..sources.files import stored

    e = edges.select(F.col(key).alias("key"), F.col(parent).alias("parent")).where("parent is not null")
    level = stored(edges.select(F.lit(start).cast(edges.schema[key].dataType).alias("key"), F.lit(0).alias("level"), F.lit(str(start)).alias("branch")).limit(1))
    out, n = level, 0
    while not level.isEmpty() and (not depth or n < depth):
        n += 1
        up = level.select(F.col("key").alias("up"), "branch")
        seen = F.contains(F.concat(F.lit(delim), "branch", F.lit(delim)), F.concat(F.lit(delim), F.col("key").cast("string"), F.lit(delim)))
        level = stored(e.join(up, F.col("parent") == F.col("up")).where(~seen).select("key", F.lit(n).alias("level"), F.concat("branch", F.lit(delim), F.col("key").cast("string")).alias("branch")))
        out = out.unionByName(level)
    return out

"""DISTINCT ON, LIMIT WITH TIES, recursive UNION, MERGE, temporal joins and pivots as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (one shuffle; Spark limits each group's rows before it)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def limit_with_ties(df: DataFrame, column: str, n: int, descending: bool = True) -> DataFrame:
    """The first n rows by a column and all rows equal to the last of them: a top-n, then a filter; no global window.

    Nulls come first in descending order and last in ascending order; they are equal to each other. All rows if they are fewer.
    """
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    taken = df.select(F.col(column).alias("v")).orderBy(order).limit(n)
    edge = taken.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count("v").alias("known"), (F.min if descending else F.max)("v").alias("v")).alias("edge")).scalar()
    c, short, known = F.col(column), edge["rows"] < n, edge["known"]
    if descending:
        return df.where(short | c.isNull() | ((known > 0) & (c >= edge["v"])))
    return df.where(short | (known < edge["rows"]) | (c <= edge["v"]))


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """UNION (distinct) recursion: step on each round's new rows until there are none, or for `most` rounds.

    Each round appends its new rows to one table; what earlier rounds found is read, never written again.
    """
    from ..sources.files import folder, stored

    spark, path = start.sparkSession, folder(start.sparkSession, "recursion")
    delta, done, n = stored(start.distinct()), None, 0
    schema = delta.schema
    while not delta.isEmpty():
        delta.write.mode("append").parquet(path)
        done = spark.read.schema(schema).parquet(path)
        if n == most:
            return done
        n += 1
        found = step(delta).select(*[F.col(c).cast(schema[c].dataType) for c in delta.columns]).distinct()
        known = done.select(*[F.col(c).alias(f"__{c}") for c in done.columns])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in done.columns]
        delta = stored(found.join(known, same, "left_anti"))
    return delta if done is None else done


@dataclass(frozen=True)
class When:
    """A branch of MERGE. match: matched, unmatched (a source row without a target row) or orphan (a target row without a source row).

    action: update, insert, delete or nothing. values: columns to set (t.* and s.* are in reach); insert and update take
    the source's columns of the same names where none are given.
    """

    match: str
    action: str
    values: dict[str, Column] | None = None
    condition: Column | None = None


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], branches: Sequence[When], returning: bool = False) -> DataFrame:
    """MERGE: the target after the first branch of each row whose condition is true; a null condition is not true.

    Null keys match nothing. A target row that several source rows would change is an error; source rows that no branch
    takes are left out. returning: the rows inserted, updated or deleted instead (deleted ones with their old values),
    with merge_action. The window and both joins use one partitioning by the keys.
    """
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    t = target.withColumn("__t", F.monotonically_increasing_id()).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    matched = F.col("s.__s").isNotNull()

    def branch(kinds: dict[str, Column]) -> Column:
        out = F.lit(-1)
        for i, b in reversed(list(enumerate(branches))):
            if b.match in kinds:
                out = F.when(kinds[b.match] & (F.coalesce(b.condition, F.lit(False)) if b.condition is not None else F.lit(True)), F.lit(i)).otherwise(out)
        return out

    def shaped(rows: DataFrame, action: str) -> DataFrame:
        out = []
        for c in target.columns:
            value = F.col(f"t.{c}") if action == "update" else F.lit(None)
            for i, b in enumerate(branches):
                if b.action == action:
                    plain = F.col(f"s.{c}") if c in source.columns and not b.values else value if action == "insert" else F.col(f"t.{c}")
                    value = F.when(F.col("__which") == i, (b.values or {}).get(c, plain)).otherwise(value)
            out.append(value.cast(target.schema[c].dataType).alias(c))
        does = lambda a: F.col("__which").isin([i for i, b in enumerate(branches) if b.action == a])
        told = F.when(does("insert"), "INSERT").when(does("update"), "UPDATE").when(does("delete"), "DELETE").alias("merge_action")
        return rows.select(told, *out)

    old = t.join(s, same, "left").withColumn("__which", branch({"matched": matched, "orphan": ~matched}))
    changes = F.col("__which").isin([i for i, b in enumerate(branches) if b.action != "nothing"])
    row = W.partitionBy(*[F.col(f"t.{k}") for k in keys], F.col("t.__t"))
    old = old.withColumns({"__changes": F.count(F.when(changes, 1)).over(row), "__nth": F.row_number().over(row.orderBy(F.desc(changes)))}).where("__nth = 1")
    twice = F.raise_error(F.lit("MERGE would change a row a second time")).cast("int")
    old = shaped(old.withColumn("__which", F.when(F.col("__changes") > 1, twice).otherwise(F.col("__which"))), "update")
    unmatched = target.alias("t").select(*[F.col(f"t.{k}").alias(k) for k in keys]).alias("t")
    new = shaped(s.join(unmatched, same, "left_anti").withColumn("__which", branch({"unmatched": F.lit(True)})), "insert").where("merge_action = 'INSERT'")
    if returning:
        return old.where("merge_action is not null").unionByName(new)
    return old.where("merge_action is null or merge_action <> 'DELETE'").unionByName(new).drop("merge_action")


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, delete: Column | None = None) -> DataFrame:
    """MERGE that deletes matched rows where asked, updates the others and inserts what has no match."""
    values = {c: (update or {}).get(c, F.col(f"s.{c}") if c in source.columns and c not in keys else F.col(f"t.{c}")) for c in target.columns}
    branches = [When("matched", "delete", condition=delete)] if delete is not None else []
    return merge(target, source, keys, [*branches, When("matched", "update", values), When("unmatched", "insert")])


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the latest right row at or before it: one union, one window, no range join.

    The values come from one right row, nulls included; of right rows of one time the greatest by values. Null keys and
    null times match nothing.
    """
    row = F.struct(*[F.col(f"r.{v}").alias(v) for v in values])
    nothing = F.lit(None).cast(T.StructType([T.StructField(v, right.schema[v].dataType) for v in values]))
    known = F.col(by).isNotNull() & F.col(left_on).isNotNull()
    marked = left.where(known).select(*left.columns, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), nothing.alias("__row"))
    r = right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull()).alias("r")
    r = r.select(*[(F.col(f"r.{by}") if c == by else F.lit(None)).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(f"r.{right_on}").alias("__at"), F.lit(0).alias("__side"), row.alias("__row"))
    w = W.partitionBy(by).orderBy("__at", "__side", "__row").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("__side") == 0, F.col("__row")), ignorenulls=True).over(w)
    found = marked.unionByName(r).withColumn("__found", latest).where("__side = 1")
    alone = left.where(~known).withColumn("__found", nothing)  # not dealt by key: null keys may be many
    return found.select(*left.columns, "__found").unionByName(alone).select(*left.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, on: str | None = None) -> DataFrame:
    """Points within [start, end) of spans: both sides go to buckets of `width`, joined by equality and then exactly."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    keys = ["__b"] + ([on] if on else [])
    return p.join(s, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def crosstab(df: DataFrame, row: str, category: str, value: Column, categories: Sequence) -> DataFrame:
    """One column per listed category; the list keeps the pivot from scanning for it."""
    return df.groupBy(row).pivot(category, list(categories)).agg(value)


def sessionize(df: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Adds session numbers per key: a gap of more than gap_seconds starts a new one."""
    w = W.partitionBy(key).orderBy(at)
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {at})")
    new = F.coalesce((micros - F.lag(micros).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys that hold more than `share` of the rows: fewer than 1 / share of them, whatever the input."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col("n") > total * share).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner", share: float = 0.01) -> DataFrame:
    """A join whose hot keys (over `share` of the left rows) are dealt to `salts` tasks; the right side repeats only those keys' rows.

    Right and full joins would return a repeated row that has no match once per salt; they are refused.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        raise ValueError(f"salted_join: {how} joins return rows of the repeated side")
    hot = F.broadcast(hot_keys(left, key, share).select(F.col(key).alias("__hot")))  # fewer than 1 / share rows
    l = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), (F.rand(7) * salts).cast("int")).otherwise(0)).drop("__hot")
    places = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(places)).drop("__hot")
    return l.join(r, [key, "__salt"], how).drop("__salt")


def running_total(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before it by a column of distinct values, without one task for all rows.

    Rows are dealt by ranges of the column and stored; each part adds up its own, and a part's start is the sum of the parts
    before it, of which there are as many as shuffle partitions.
    """
    from ..sources.files import stored

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, order).withColumns({"__part": F.spark_partition_id(), "__value": value})
    dealt = stored(dealt)
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # over `parts` rows
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum("__value").over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + own).select(*df.columns, name)  # `parts` rows


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row q0, q1, …: interpolated quantiles as percentile_cont gives them, without one task for all rows.

    Equal values are counted before they are dealt; running counts over ranges then tell which values have the ranks asked for.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, "v", F.col("n"), "before")
    total = ranked.agg(F.sum("n").alias("n")).scalar()
    out = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (total - 1)
        low, high = F.floor(place), F.ceil(place)
        at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("v")))
        out.append((at(low) + (at(high) - at(low)) * (F.max(place) - F.max(low))).alias(f"q{i}"))
    return ranked.agg(*out)

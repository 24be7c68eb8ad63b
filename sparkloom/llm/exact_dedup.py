"""Exact dedup by a log-structured merge index. DataFrame functions only.

A batch of texts is inserted by memtables: each scan task sorts its (digest, id) rows and flushes them as one run, a Parquet
file with a Bloom filter on the digest. Merging the flushed runs gives one sorted run of level 0 with a row per digest: the
identifier that stays (the smallest in the order given: here the largest doc_id comes first) and the number of rows. Each
run of a level keeps a filter of its digests, of fixed size. When a level holds FANOUT runs, compaction merges them into one
run of the next level, so a digest is rewritten once a level and not once a batch.

A batch asks every older run's filter for its digests; a run that no digest passes is skipped without being read, and of
the others only the digests in question take part. Digests of several rows are hits: the bytes of their texts are compared,
and texts that differ under one digest are grouped by the text itself.

Defined results. A null text is an empty text. A null id comes after every other id, so its row stays only in a group of
null ids. Repeated rows (same id, same text) are separate rows of which one stays. An empty table gives an empty result.
Other columns are never looked at; any name may occur among them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import HOT, Filter, join_hot, maybe_in
from .runtime import drop, written

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Copies of a row that one array numbers; more of them take several arrays.
SPAN = 1 << 16


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """A sorted table (digest, keep_id, group_size) with a row per digest, and its filter."""

    level: int
    rows: DataFrame
    filter: Filter


class MergeIndex:
    """The runs of an index in the shared folder, newest last."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.runs = spark, fanout, []
        #: Runs that lookups read, and runs that their filters spared them.
        self.read = self.skipped = 0

    def insert(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (digest, id); the flushed memtables are returned, a sorted run for each scan task."""
        flushed = written(rows.sortWithinPartitions("digest", "id"), "dedup-memtables", bloom="digest")
        # partial aggregation takes place before the shuffle, so a hot digest is one row a task
        self._add(0, flushed.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        self.compact()
        return flushed

    def _add(self, level: int, rows: DataFrame) -> None:
        run = written(rows.sortWithinPartitions("digest"), f"dedup-level{level}", bloom="digest")
        self.runs.append(Run(level, run, Filter(run, "digest")))

    def compact(self) -> None:
        """Merges full levels, the lowest first."""
        while full := [n for n in {r.level for r in self.runs} if sum(r.level == n for r in self.runs) >= self.fanout]:
            old = [r for r in self.runs if r.level == min(full)]
            self._add(min(full) + 1, merged([r.rows for r in old]))
            self.runs = [r for r in self.runs if r not in old]
            for r in old:
                drop(r.rows, r.filter.bits)

    def entries(self, batch: DataFrame) -> DataFrame:
        """The merged entries of the digests of a batch that has been inserted."""
        if len(self.runs) == 1:
            self.read += 1
            return self.runs[0].rows
        wanted = written(batch.select("digest").distinct(), "dedup-asked")
        found = []
        for r in self.runs:
            asked = wanted.where(r.filter.may_hold(F.col("digest")))
            if asked.isEmpty():
                self.skipped += 1
                continue
            self.read += 1
            found.append(r.rows.join(asked, "digest", "left_semi"))
        out = written(merged(found), "dedup-entries")
        drop(wanted)
        return out

    def drop(self) -> None:
        for r in self.runs:
            drop(r.rows, r.filter.bits)
        self.runs = []


def merged(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


class Batch:
    """Documents as rows of an index."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]):
        self.docs, self.id = docs, docs[id_col].cast("long")
        self.text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        self.digest = digest(self.text)

    def rows(self) -> DataFrame:
        return self.docs.select(self.digest.alias("digest"), self.id.alias("id"))

    def bodies(self, where: Column) -> DataFrame:
        return self.docs.where(where).select(self.digest.alias("digest"), self.text.alias("body"), self.id.alias("id"))


def differing(held: Filter, batches: list[Batch]) -> DataFrame | None:
    """The digests of several rows (and few others, by their filter) under which the bytes of the texts differ; None: none."""
    rows = [b.bodies(held.may_hold(b.digest)).select("digest", "body") for b in batches]
    # all bytes are equal if the least and the greatest text are; each task sends two texts a digest at most
    found = reduce(DataFrame.unionByName, rows).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    out = written(found.where("low <> high").select("digest"), "dedup-differ")
    if out.isEmpty():
        drop(out)
        return None
    return out


def with_entries(flushed: DataFrame, hits: DataFrame, held: Filter) -> DataFrame:
    """digest, id, n (rows of that digest and id), keep_id, group_size of all rows of a batch; hits: entries of several rows.

    Rows that the filter of hits stops are alone and stay where they are. The rest is counted by (digest, id), and hits of
    more than one row in 256 are broadcast, so no group of copies meets in a task.
    """
    maybe = held.may_hold(F.col("digest"))
    one, own = F.lit(1).cast("long"), F.col("id")
    alone = flushed.where(~maybe).select("digest", "id", one.alias("n"), own.alias("keep_id"), one.alias("group_size"))
    counted = flushed.where(maybe).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    hot = hits.where(F.col("group_size") * HOT > flushed.agg(F.count(F.lit(1)).alias("n")).scalar())
    hot = hot.orderBy(F.desc("group_size"), "digest").limit(HOT)  # a batch alone has no more; an index may be larger than its batch
    told = join_hot(counted, hits.withColumn("hit", F.lit(True)), ["digest"], "left", hot=hot)
    told = told.select("digest", "id", "n", F.when(F.col("hit"), F.col("keep_id")).otherwise(own).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"))
    return alone.unionByName(told)


def copies(rows: DataFrame) -> DataFrame:
    """Each row n times, as `copy` 1 to n."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPAN}"))))
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * SPAN + 1, F.least("n", (F.col("block") + 1) * SPAN)))).drop("block")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest, index: MergeIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest in hexadecimal).

    index, earlier: an index that holds earlier documents, and those; groups and the row that stays then span both.
    """
    batch = Batch(docs, id_col, text_col, digest)
    every = [batch] + ([Batch(earlier, id_col, text_col, digest)] if earlier is not None else [])
    own = index or MergeIndex(docs.sparkSession)
    flushed = own.insert(batch.rows())
    entries = own.entries(flushed)
    hits = written(entries.where("group_size > 1").select("digest", "keep_id", "group_size"), "dedup-hits")
    held = Filter(hits, "digest")
    differ = differing(held, every)
    if index is None:
        own.drop()
    shape = lambda rows: copies(rows).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
    told = with_entries(flushed, hits, held)
    if differ is None:
        return shape(told)
    apart = batch.bodies(maybe_in(differ, "digest", batch.digest)).join(differ, "digest", "left_semi")
    others = reduce(DataFrame.unionByName, [b.bodies(maybe_in(differ, "digest", b.digest)) for b in every]).join(differ, "digest", "left_semi")
    groups = others.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = apart.groupBy("digest", "body", "id").agg(F.count(F.lit(1)).alias("n")).join(groups, ["digest", "body"]).select("digest", "id", "n", "keep_id", "group_size")
    return shape(told.join(differ, "digest", "left_anti").unionByName(apart))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows with copies only those that stay, and few more, are shuffled."""
    batch, own = Batch(docs, id_col, text_col, digest), MergeIndex(docs.sparkSession)
    flushed = own.insert(batch.rows())
    hits = written(own.entries(flushed).where("group_size > 1").select("digest", "keep_id", "group_size"), "dedup-hits")
    own.drop()
    held = Filter(hits, "digest")
    differ = differing(held, [batch])
    packed = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    maybe = held.may_hold(batch.digest)
    if differ is not None:  # digests that meet: the texts themselves decide
        rows = docs.where(maybe).select(packed, batch.digest.alias("digest"), batch.text.alias("body"), batch.id.alias("id"))
        top = rows.groupBy("digest", "body").agg(F.max("id").alias("top"))
        one = rows.join(top, ["digest", "body"]).where(F.col("id").eqNullSafe(F.col("top"))).groupBy("digest", "body").agg(F.first("row").alias("row"))
        drop(flushed)
        return docs.where(~maybe).unionByName(one.select("row.*"))
    # what the filter lets through: rows that stay (of a hit, the one of its identifier), by (digest, id), without texts
    told = with_entries(flushed.where(held.may_hold(F.col("digest"))), hits, held)
    stay = written(told.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias("d"), F.col("id").alias("i"), "n"), "dedup-stay")
    drop(flushed)
    asked = maybe_in(stay.select(F.xxhash64("d", "i").alias("k")), "k", F.xxhash64(batch.digest, batch.id))
    rows = docs.where(maybe & asked).select(packed, batch.digest.alias("digest"), batch.id.alias("id"))
    rows = rows.join(stay, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")))
    one = rows.where("n > 1").groupBy("digest", "id").agg(F.first("row").alias("row")).select("row")
    return docs.where(~maybe).unionByName(rows.where("n = 1").select("row").unionByName(one).select("row.*"))

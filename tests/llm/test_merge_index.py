"""The index of exact dedup over several batches."""

import hashlib

from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup as ed


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_two_batches_share_groups_and_identifiers(spark):
    one = [(1, "a"), (5, "b"), (3, "a"), (None, "c"), (7, None)]
    two = [(2, "a"), (9, "b"), (9, "b"), (4, "new"), (None, "c"), (6, "")]
    index = ed.MergeIndex(spark)
    first = ed.exact_dedup(docs_of(spark, one), index=index).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in first) == [(0, 0, 1), (1, 3, 2), (3, 3, 2), (5, 5, 1), (7, 7, 1)]
    second = ed.exact_dedup(docs_of(spark, two), index=index, earlier=docs_of(spark, one)).collect()
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in second)
    assert got == [(0, 0, 2, True), (2, 3, 3, False), (4, 4, 1, True), (6, 7, 2, False), (9, 9, 3, False), (9, 9, 3, True)]
    assert {r["text_sha256"] for r in second if r["doc_id"] == 4} == {hashlib.sha256(b"new").hexdigest()}


def test_runs_whose_filters_stop_a_batch_are_skipped(spark):
    index = ed.MergeIndex(spark, fanout=100)
    for k in range(3):
        ed.exact_dedup(docs_of(spark, [(10 * k + i, f"text {k} {i}") for i in range(5)]), index=index)
    index.read = index.skipped = 0
    got = ed.exact_dedup(docs_of(spark, [(99, "text 1 3"), (100, "other")]), index=index, earlier=docs_of(spark, [(13, "text 1 3")])).collect()
    assert (index.read, index.skipped) == (2, 2)  # its own run and the one that holds the text
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(99, 99, 2), (100, 100, 1)]


def test_full_levels_are_merged_upwards(spark):
    index, seen = ed.MergeIndex(spark, fanout=2), {}
    for k in range(7):
        batch = [(100 * k + i, f"t{(i * (k + 1)) % 11}") for i in range(6)]
        for i, t in batch:
            seen.setdefault(t, []).append(i)
        index.insert(docs_of(spark, batch).select(ed.sha256_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("id")))
    assert sorted(r.level for r in index.runs) == [0, 1, 2]
    every = ed.merged([r.rows for r in index.runs]).collect()
    want = {hashlib.sha256(t.encode()).digest(): (max(i), len(i)) for t, i in seen.items()}
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in every} == want


def test_a_third_of_all_rows_alike(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = ed.exact_dedup(rows).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, True, 2000), (1000, True, 1), (1000, False, 999)}
    assert ed.keep_first(rows).count() == 2001 and ed.keep_first(rows).where("text = 'same'").first()["doc_id"] == 2997


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(ed, "SPAN", 7)
    rows = spark.range(50).select(F.lit(4).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert {tuple(r) for r in ed.exact_dedup(rows).groupBy("doc_id", "kept", "group_size").count().collect()} == {(4, True, 50, 1), (4, False, 50, 49)}
    assert ed.keep_first(rows).count() == 1

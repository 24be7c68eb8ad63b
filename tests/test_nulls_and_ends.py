"""Operators on rows that hold nulls, fractions, line ends and repeated keys."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import relational as ops


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_merge_keeps_a_row_whose_condition_is_null(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "k int, v int")
    s = spark.createDataFrame([(1, None), (None, 7)], "k int, v int")
    assert as_set(ops.merge_upsert(t, s, ["k"], {"v": F.col("t.v")}, delete=F.col("s.v") < 0)) == {(1, 10), (2, 20), (None, 5), (None, 7)}


def test_merge_refuses_to_change_a_row_twice(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    s = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4)], "k int, v int")
    with pytest.raises(PySparkException, match="second time"):
        ops.merge_upsert(t, s, ["k"]).collect()
    nothing = [ops.When("matched", "nothing"), ops.When("unmatched", "insert")]
    assert sorted(map(tuple, ops.merge(t, s, ["k"], nothing).collect())) == [(1, 10), (2, 20), (3, 3), (3, 4)]


def test_merge_takes_the_first_branch_that_holds(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "k int, v int")
    s = spark.createDataFrame([(1, -1), (2, 5), (3, 0), (9, 90), (8, -8)], "k int, v int")
    branches = [
        ops.When("matched", "delete", condition=F.col("s.v") < 0), ops.When("matched", "nothing", condition=F.col("s.v") == 0), ops.When("matched", "update", {"v": F.col("t.v") + F.col("s.v")}),
        ops.When("unmatched", "insert", condition=F.col("s.v") > 0), ops.When("orphan", "update", {"v": F.lit(0)}),
    ]
    assert as_set(ops.merge(t, s, ["k"], branches)) == {(2, 25), (3, 30), (4, 0), (9, 90)}
    assert as_set(ops.merge(t, s, ["k"], branches, returning=True)) == {("DELETE", 1, 10), ("UPDATE", 2, 25), ("UPDATE", 4, 0), ("INSERT", 9, 90)}


def test_asof_join_takes_one_row_with_its_nulls(spark):
    quotes = spark.createDataFrame([("a", 3, 30, 1), ("a", 4, None, 2), (None, 1, 7, 7), ("a", None, 9, 9)], "k string, t int, v int, w int")
    trades = spark.createDataFrame([("a", 3), ("a", 5), ("a", 1), (None, 5), ("a", None)], "k string, t int")
    got = as_set(ops.asof_join(trades, quotes, "k", "t", "t", ["v", "w"]))
    assert got == {("a", 3, 30, 1), ("a", 5, None, 2), ("a", 1, None, None), (None, 5, None, None), ("a", None, None, None)}


def test_limit_with_ties_counts_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 4), (4, None), (5, 5)], "id int, v int")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(ops.limit_with_ties(df, "v", 10)) == {1, 2, 3, 4, 5} == ids(ops.limit_with_ties(df, "v", 10, False))
    assert ids(ops.limit_with_ties(df, "v", 1)) == {2, 4} == ids(ops.limit_with_ties(df, "v", 2))
    assert ids(ops.limit_with_ties(df, "v", 3)) == {1, 2, 4, 5}
    assert ids(ops.limit_with_ties(df, "v", 2, False)) == {1, 3, 5}
    assert ids(ops.limit_with_ties(df, "v", 4, False)) == {1, 2, 3, 4, 5}


def test_interval_join_with_fractional_ends(spark):
    p = spark.createDataFrame([(8.2,), (8.5,), (-0.5,)], "x double")
    s = spark.createDataFrame([(1, 0.0, 8.5), (2, 3.0, 3.0), (3, -1.0, -0.25), (4, None, 9.0)], "s int, a double, b double")
    assert as_set(ops.interval_join(p, s, "x", "a", "b", 4).select("x", "s")) == {(8.2, 1), (-0.5, 3)}


def test_salted_join_salts_hot_keys_only_and_refuses_outer_right(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(0, "a"), (250, "b"), (999, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, ops.salted_join(left, right, "k", how=how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    assert as_set(ops.hot_keys(left, "k", 0.01)) == {(0,)}
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            ops.salted_join(left, right, "k", how=how)


def test_first_match_is_replaced_behind_line_ends(spark):
    df = spark.createDataFrame([("a\n0b0",), ("none",), (None,)], "t string")
    assert as_set(df.select(text.replace_first(F.col("t"), "0", "Z"))) == {("a\nZb0",), ("none",), (None,)}


def test_weighted_edit_distance_by_plain_loops(spark):
    def plain(x, y, i, d, c):
        row = [j * i for j in range(len(y) + 1)]
        for k, p in enumerate(x, 1):
            new = [k * d]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + d, new[-1] + i, row[j - 1] + (0 if p == q else c)))
            row = new
        return row[-1]

    rows = [(x, y, i, d, c) for x in ("", "kitten", "sitting", "ñandú", "a" * 40, None) for y in ("", "sitting", "nandu", "abc" * 9) for i, d, c in ((1, 1, 1), (2, 1, 3), (1, 5, 2))]
    df = spark.createDataFrame(rows, "x string, y string, i int, d int, c int")
    for r in df.select("*", text.weighted_levenshtein("x", "y", "i", "d", "c").alias("got")).collect():
        assert r["got"] == (None if r["x"] is None else plain(r["x"], r["y"], r["i"], r["d"], r["c"]))


def test_recursion_appends_rounds_and_may_be_bounded(spark):
    start = spark.createDataFrame([(1, None)], "a int, b string")
    step = lambda d: d.select(((F.col("a") * 3) % 50).alias("a"), "b")
    want, x = set(), 1
    while x not in want:
        want.add(x)
        x = x * 3 % 50
    assert as_set(ops.recursive_union(start, step)) == {(v, None) for v in want}
    assert len(as_set(ops.recursive_union(start, step, most=3))) == 4
    assert ops.recursive_union(start.where("false"), step).count() == 0


def test_nfc_of_whole_texts(spark):
    import unicodedata

    texts = ["plain " * 100 + "é", "é\n", "ascii\nonly", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert as_set(df.select(text.normalize_nfc(F.col("t")))) == {(unicodedata.normalize("NFC", t) if t is not None else None,) for t in texts}

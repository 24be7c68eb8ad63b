"""Operators on small tables: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from sparkloom.functions import numbers, structures, text
from sparkloom.ml import predict as ml
from sparkloom.operators import relational as ops
from sparkloom.sources import files


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_asof_join_takes_equal_times_and_nulls_without_match(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 3, 30), ("c", 1, 10)], "k string, t int, v int")
    assert as_set(ops.asof_join(left, right, "k", "t", "t", ["v"]).select("id", "v")) == {(1, 50), (2, None), (3, None)}


def test_interval_join_counts_each_pair_once(spark):
    p = spark.createDataFrame([(i,) for i in range(30)], "x int")
    s = spark.createDataFrame([(1, 3, 27), (2, 10, 11)], "s int, a int, b int")
    got = ops.interval_join(p, s, "x", "a", "b", 4).select("x", "s").collect()
    assert len(got) == 25 and len({tuple(r) for r in got}) == 25


def test_limit_with_ties_keeps_peers(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 4), (5, 1)], "id int, v int")
    assert as_set(ops.limit_with_ties(df, "v", 3)) == {(1, 5), (2, 5), (3, 4), (4, 4)}
    assert ops.limit_with_ties(df.where("false"), "v", 3).count() == 0


def test_merge_updates_inserts_and_deletes(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    s = spark.createDataFrame([(2, 5), (3, -1), (4, 40)], "k int, v int")
    got = ops.merge_upsert(t, s, ["k"], {"v": F.col("t.v") + F.col("s.v")}, delete=F.col("s.v") < 0)
    assert as_set(got) == {(1, 10), (2, 25), (4, 40)}


def test_recursive_union_ends_on_a_cycle(spark):
    start = spark.createDataFrame([(1,)], "a int")
    got = ops.recursive_union(start, lambda d: d.select(((F.col("a") * 2) % 7).alias("a")))
    assert as_set(got) == {(1,), (2,), (4,)}


def test_salted_join_equals_join(spark):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert as_set(ops.salted_join(left, right, "k").select("x", "v")) == as_set(left.join(right, "k").select("x", "v"))


def test_connectby_and_lquery(spark):
    e = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("r2", "x")], "k string, p string")
    assert as_set(structures.connectby(e, "k", "p", "r")) == {("r", 0, "r"), ("a", 1, "r~a"), ("b", 2, "r~a~b")}
    p = spark.createDataFrame([("top.sci.astro",), ("top.hobby",)], "p string")
    assert as_set(p.where(structures.lquery(F.col("p"), "*.sci.*"))) == {("top.sci.astro",)}
    assert as_set(p.where(structures.lquery(F.col("p"), "top.!sci"))) == {("top.hobby",)}


def test_strings_and_numbers(spark):
    r = spark.createDataFrame([("hello", "word", 12, 18)], "a string, b string, x int, y int").select(
        text.left(F.col("a"), -2), text.right(F.col("a"), -2), text.concat(F.col("a"), F.lit(None), F.col("b")), F.round(text.similarity(F.col("b"), F.lit("two words")), 4),
        numbers.gcd(F.col("x"), F.col("y")), numbers.lcm(F.col("x"), F.col("y")), text.quote_literal(F.lit("o'k")), numbers.gcd(F.lit(0), F.lit(5)),
    ).first()
    assert list(r) == ["hel", "llo", "helloword", 0.3636, 6, 36, "'o''k'", 5]


def test_quantisation_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, -1.0, 2.0],), ([3.0, 3.0],)], "v array<double>")
    for v, w in df.select("v", numbers.dequantize(numbers.quantize(F.col("v")))).collect():
        assert max(abs(a - b) for a, b in zip(v, w, strict=True)) <= (max(v) - min(v)) / 255 + 1e-9 or len(set(v)) == 1


def test_csv_round_trip_and_defaults(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, 'q"q')], "i int, t string")
    assert as_set(files.through_csv(df, sep="|", null_value="\\N")) == as_set(df)
    assert as_set(files.with_defaults(df, "a|b", {"t": "x"}).where("i = 1")) == {(1, "x")}


def test_predict_trains_once_and_honours_where(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 1).cast("double").alias("y"))
    registry = ml.Registry.new(spark)
    out = ml.predict(rows, "y", ["x"], "value", "t", registry, where="x < 10")
    assert out.count() == 10 and all(abs(r["result"] - r["y"]) < 5 for r in out.collect())
    ml.predict(rows, "y", ["x"], "value", "t", registry)
    assert registry.all().count() == 1


def test_auc_of_one_class_is_zero(spark):
    assert ml.auc(spark.createDataFrame([(0.1, 1), (0.3, 1)], "s double, y int"), "s", "y").first()[0] == 0.0
    assert ml.auc(spark.createDataFrame([(0.1, 0), (0.3, 1)], "s double, y int"), "s", "y").first()[0] == 1.0

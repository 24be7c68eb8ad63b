"""Values, dates, patterns and changes on small tables: nulls, ends of ranges, errors."""

import hashlib
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import dates, documents, numbers, patterns, values
from sparkloom.operators import dml


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_strides(spark):
    assert dates.stride_micros("1 hour 30 minutes") == 5_400_000_000
    for bad in ("1 month", "2 years", "0 seconds", "-5 minutes"):
        with pytest.raises(ValueError):
            dates.stride_micros(bad)


def test_ages_and_justified_intervals(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    a = one(spark, dates.age(t("2001-04-10 00:00:00"), t("1957-06-13 00:00:00")), dates.age(t("1957-06-13 00:00:00"), t("2001-04-10 00:00:00")), dates.age(t("2024-03-01 01:00:00"), t("2024-01-31 02:00:00")))
    assert tuple(a[0]) == (43, 9, 27, 0) and tuple(a[1]) == (-43, -9, -27, 0) and tuple(a[2]) == (0, 1, 0, 82_800_000_000)
    hour = 3_600_000_000
    h = one(spark, dates.justify_hours(F.lit(1), F.lit(-hour)), dates.justify_hours(F.lit(0), F.lit(27 * hour)), dates.justify_days(F.lit(1), F.lit(-40)))
    assert tuple(h[0]) == (0, 23 * hour) and tuple(h[1]) == (1, 3 * hour) and tuple(h[2]) == (0, -10)
    assert one(spark, dates.make_time(F.lit(8), F.lit(15), F.lit(23.5)), dates.make_time(F.lit(25), F.lit(0), F.lit(0.0))) == [29_723_500_000, None]


def test_patterns(spark):
    got = one(spark, *[F.lit(s).rlike(patterns.similar_to(p)) for s, p in (("abc", "a(b|x)c"), ("abc", "b"), ("a.c", "a.c"), ("axc", "a.c"), ("50%", r"50\%"), ("a\nb", "a_b"))])
    assert got == [True, False, True, False, True, True]
    assert one(spark, patterns.format_text("%s %I %L %% %3$s", F.lit("a"), F.lit("My col"), F.lit(None))) == ["a \"My col\" NULL % "]
    v = patterns.tsvector(F.lit("The quick foxes jumped over the lazy dog"))
    ask = lambda q: patterns.tsquery(v, q)
    assert one(spark, ask("fox & dogs"), ask("quick <-> fox"), ask("fox <-> quick"), ask("!cat & (cow | lazy)"), ask("jum:*"), ask("the")) == [True, True, False, True, True, False]
    for bad in ("a &", "(a", "a b", "| a"):
        with pytest.raises(ValueError):
            patterns.tsquery(v, bad)


def test_values(spark):
    n = "example.org"
    assert one(spark, values.uuid_v3("dns", F.lit(n)), values.uuid_v5("dns", F.lit(n))) == [str(uuid.uuid3(uuid.NAMESPACE_DNS, n)), str(uuid.uuid5(uuid.NAMESPACE_DNS, n))]
    i = F.lit("192.168.1.77/26")
    assert one(spark, values.network(i), values.broadcast(i), values.netmask(i), values.address(F.lit("1.2.3.400"))) == ["192.168.1.64/26", "192.168.1.127/26", "255.255.255.192", None]
    assert one(spark, values.is_ean13(F.lit("978-0-306-40615-7")), values.isbn10(F.lit("9780306406157")), values.is_ean13(F.lit("x"))) == [True, "0306406152", False]
    assert one(spark, numbers.erf(F.lit(0.5)), numbers.erf(F.lit(-1.0)), numbers.erf(F.lit(7.0))) == [pytest.approx(0.5204998778), pytest.approx(-0.8427007929), pytest.approx(1.0)]


def test_json(spark):
    assert one(spark, *[documents.json_kind(F.lit(s)) for s in ('{"a":1}', "[1]", "3", '"x"', "{")]) == ["object", "array", "scalar", "scalar", None]
    assert one(spark, documents.json_set(F.lit('{"a":"x","b":[1]}'), "a", F.lit("2")), documents.json_set(F.lit('{"a":1}'), "z", F.lit("true"), create=False)) == ['{"a":2,"b":[1]}', '{"a":1}']


def test_digests(spark):
    assert one(spark, F.sha2(F.lit("abc"), 224), F.sha2(F.lit("abc"), 384), F.sha2(F.lit("abc"), 512)) == [hashlib.new(h, b"abc").hexdigest() for h in ("sha224", "sha384", "sha512")]


def test_changes_with_null_conditions_and_keys(spark):
    t = spark.createDataFrame([(1, 10), (2, None), (None, 5)], "k int, v int")
    kept, gone = dml.delete(t, F.col("v") > 6)
    assert as_set(kept) == {(2, None), (None, 5)} and as_set(gone) == {(1, 10)}
    assert as_set(dml.update(t, {"v": F.lit(0)}, F.col("v") > 6)[0]) == {(1, 0), (2, None), (None, 5)}
    new = spark.createDataFrame([(1, 1), (3, 3), (None, 7)], "k int, v int")
    assert as_set(dml.insert_on_conflict(t, new, ["k"])[1]) == {(3, 3), (None, 7)}
    assert as_set(dml.insert_on_conflict(t, new, ["k"], {"v": F.col("excluded.v")})[0]) == {(1, 1), (2, None), (None, 5), (3, 3), (None, 7)}
    with pytest.raises(PySparkException, match="second time"):
        dml.insert_on_conflict(t, new.unionByName(new), ["k"], {"v": F.col("excluded.v")})[0].collect()


def test_block_samples_repeat(spark):
    rows = spark.range(1000).withColumn("b", F.floor(F.col("id") / 50))
    a, b = (as_set(numbers.sample_blocks(rows, "b", 40.0, seed=3)) for _ in range(2))
    assert a == b and 0 < len(a) < 1000 and len(a) % 50 == 0
    assert numbers.sample_blocks(rows, "b", 0.0, seed=3).count() == 0 and numbers.sample_blocks(rows, "b", 100.0, seed=3).count() == 1000
    with pytest.raises(ValueError):
        numbers.sample_blocks(rows, "b", 101.0, seed=3)

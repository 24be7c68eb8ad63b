"""Identifiers, addresses, product numbers, segments, cubes and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import values as v
from .registry import load, query, sql


@query(
    "uuid_names",
    """SELECT n_nationkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-3' || substr(d, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(d, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS v3,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS v5
       FROM (SELECT n_nationkey, md5(unhex('6ba7b8109dad11d180b400c04fd430c8') || n_name::BLOB) AS d, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || n_name::BLOB) AS h FROM nation) t""",
)
def uuid_names(spark, sf_dir):
    n = F.col("n_name")
    return load(spark, sf_dir, "nation").select("n_nationkey", v.uuid_v3("dns", n).alias("v3"), v.uuid_v5("url", n).alias("v5"))


sql("uuid_random", "SELECT count(DISTINCT u) = count(*) AS all_different, bool_and(u RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') AS shape FROM (SELECT uuid() AS u FROM customer) t", "SELECT true AS all_different, true AS shape")

_INET = "'10.' || (s_suppkey % 7) || '.' || (s_suppkey % 250) || '.' || (s_suppkey * 7 % 256) || '/' || (16 + s_suppkey % 13)"
_PARTS = "SELECT *, (10::BIGINT << 24) + ((s_suppkey % 7) << 16) + ((s_suppkey % 250) << 8) + s_suppkey * 7 % 256 AS a, 16 + s_suppkey % 13 AS m FROM supplier"
_DOTTED = "(({0}) >> 24) || '.' || ((({0}) >> 16) & 255) || '.' || ((({0}) >> 8) & 255) || '.' || (({0}) & 255)"


@query(
    "inet_functions",
    f"""SELECT s_suppkey, {_DOTTED.format('a')} AS host, m::INT AS masklen, {_DOTTED.format('a - a % (1::BIGINT << (32 - m))')} || '/' || m AS network, {_DOTTED.format('a - a % (1::BIGINT << (32 - m)) + (1::BIGINT << (32 - m)) - 1')} || '/' || m AS broadcast,
        {_DOTTED.format('(1::BIGINT << 32) - (1::BIGINT << (32 - m))')} AS netmask, m > 16 AND (a >> 16) = (10::BIGINT << 8) + 3 AS inside FROM ({_PARTS}) t""",
)
def inet_functions(spark, sf_dir):
    s = F.col("s_suppkey")
    inet = F.concat(F.lit("10."), s % 7, F.lit("."), s % 250, F.lit("."), s * 7 % 256, F.lit("/"), s % 13 + 16)
    i = F.col("i")
    return load(spark, sf_dir, "supplier").select("s_suppkey", inet.alias("i")).select("s_suppkey", v.host(i).alias("host"), v.masklen(i).alias("masklen"), v.network(i).alias("network"), v.broadcast(i).alias("broadcast"), v.netmask(i).alias("netmask"), v.contained(i, F.lit("10.3.0.0/16")).alias("inside"))


@query(
    "product_numbers",
    """SELECT p_partkey, e || c AS ean, true AS good, false AS bad, substr(e, 4) || CASE (11 - t % 11) % 11 WHEN 10 THEN 'X' ELSE ((11 - t % 11) % 11)::VARCHAR END AS isbn FROM (
       SELECT p_partkey, e, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(e, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS c, list_sum(list_transform(range(1, 10), lambda i: substr(e, i + 3, 1)::INT * (11 - i))) AS t
       FROM (SELECT p_partkey, '978' || lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS e FROM part) a) b""",
)
def product_numbers(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")).alias("e"))
    p = p.withColumn("c", v.ean13_check(F.col("e"))).withColumn("ean", F.concat("e", "c"))
    wrong = F.concat("e", F.pmod(F.col("c") + 1, F.lit(10)))
    return p.select("p_partkey", "ean", v.is_ean13(F.col("ean")).alias("good"), v.is_ean13(wrong).alias("bad"), v.isbn10(F.col("ean")).alias("isbn"))


@query(
    "seg_ops",
    """SELECT l_orderkey, l_linenumber, least(lo, 10) AS ulo, greatest(hi, 20) AS uhi, CASE WHEN lo <= 20 AND hi >= 10 THEN greatest(lo, 10) END AS ilo, lo <= 20 AND hi >= 10 AS meets, 10 <= lo AND hi <= 20 AS within, hi - lo AS size, (lo + hi) / 2 AS center
       FROM (SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem) t""",
)
def seg_ops(spark, sf_dir):
    a, b = F.col("a"), v.seg(F.lit(10.0), F.lit(20.0))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.seg(F.col("l_quantity") + F.col("l_linenumber"), F.col("l_quantity")).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", v.seg_union(a, b)["lo"].alias("ulo"), v.seg_union(a, b)["hi"].alias("uhi"), v.seg_inter(a, b)["lo"].alias("ilo"), v.seg_overlap(a, b).alias("meets"), v.seg_contains(b, a).alias("within"), (a["hi"] - a["lo"]).alias("size"), ((a["lo"] + a["hi"]) / 2).alias("center"))


@query(
    "cube_ops",
    """SELECT s_suppkey, x <= 12 AND x + 3 >= 5 AND y <= 12 AND y + 3 >= 5 AS meets, x >= 5 AND x + 3 <= 12 AND y >= 5 AND y + 3 <= 12 AS within, (greatest(x + 3, 12) - least(x, 5)) * (greatest(y + 3, 12) - least(y, 5)) AS union_size,
       round(sqrt(greatest(x - 12, 5 - (x + 3), 0) ** 2 + greatest(y - 12, 5 - (y + 3), 0) ** 2), 6) AS d FROM (SELECT s_suppkey, (s_suppkey * 37 % 20)::DOUBLE AS x, (s_suppkey * 91 % 20)::DOUBLE AS y FROM supplier) t""",
)
def cube_ops(spark, sf_dir):
    x, y = (F.col("s_suppkey") * 37 % 20).cast("double"), (F.col("s_suppkey") * 91 % 20).cast("double")
    a, b = F.col("a"), F.struct(F.array(F.lit(5.0), F.lit(5.0)).alias("lo"), F.array(F.lit(12.0), F.lit(12.0)).alias("hi"))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.array(x, y).alias("lo"), F.array(x + 3, y + 3).alias("hi")).alias("a"))
    return rows.select("s_suppkey", v.cube_overlap(a, b).alias("meets"), v.cube_contains(b, a).alias("within"), v.cube_size(v.cube_union(a, b)).alias("union_size"), F.round(v.cube_distance(a, b), 6).alias("d"))


_EARTH = "2 * 6378168.0 * asin(least(1.0, sqrt((x - 6378168.0 * cos(radians(48.0)) * cos(radians(11.0))) ** 2 + (y - 6378168.0 * cos(radians(48.0)) * sin(radians(11.0))) ** 2 + (z - 6378168.0 * sin(radians(48.0))) ** 2) / (2 * 6378168.0)))"


@query(
    "earth_box",
    f"""SELECT s_suppkey, round({_EARTH}, 2) AS m FROM (SELECT s_suppkey, 6378168.0 * cos(radians(lat)) * cos(radians(lon)) AS x, 6378168.0 * cos(radians(lat)) * sin(radians(lon)) AS y, 6378168.0 * sin(radians(lat)) AS z
        FROM (SELECT s_suppkey, (s_nationkey + 35)::DOUBLE AS lat, (s_suppkey % 30)::DOUBLE AS lon FROM supplier) a) b WHERE {_EARTH} <= 1000000""",
)
def earth_box(spark, sf_dir):
    here = v.ll_to_earth(F.lit(48.0), F.lit(11.0))
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", v.ll_to_earth((F.col("s_nationkey") + 35).cast("double"), (F.col("s_suppkey") % 30).cast("double")).alias("p"))
    near = rows.where(v.in_earth_box(F.col("p"), here, 1_000_000)).select("s_suppkey", v.earth_distance(F.col("p"), here).alias("d"))
    return near.where("d <= 1000000").select("s_suppkey", F.round("d", 2).alias("m"))


@query(
    "plane_shapes",
    """SELECT n_nationkey, 2.0 * w * w AS area, w::DOUBLE AS cx, w / 2.0 AS cy, 1.5 < 2 * w AND 0.5 < w AS inside, sqrt((w - 2) ** 2 + 9.0) <= w + 2.0 AS meets FROM (SELECT n_nationkey, (n_nationkey % 5 + 1)::DOUBLE AS w FROM nation) t""",
)
def plane_shapes(spark, sf_dir):
    w = (F.col("n_nationkey") % 5 + 1).cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    shape = F.array(at(zero, zero), at(2 * w, zero), at(2 * w, w), at(zero, w))
    circle = lambda x, y, r: F.struct(x.alias("x"), y.alias("y"), r.alias("r"))
    rows = load(spark, sf_dir, "nation").select("n_nationkey", shape.alias("s"), circle(w, zero, w).alias("c"))
    s = F.col("s")
    return rows.select(
        "n_nationkey", v.polygon_area(s).alias("area"), v.polygon_center(s)["x"].alias("cx"), v.polygon_center(s)["y"].alias("cy"), v.polygon_contains(s, F.lit(1.5), F.lit(0.5)).alias("inside"),
        v.circles_overlap(F.col("c"), circle(F.lit(2.0), F.lit(3.0), F.lit(2.0))).alias("meets"),
    )


@query("erf", "SELECT n_nationkey, round(e, 7) AS e FROM nation JOIN (VALUES (0, 0.0), (1, 0.5204999), (2, 0.8427008), (3, 0.9661051), (4, 0.9953223)) t(r, e) ON n_regionkey = r")
def erf(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.round(numbers.erf(F.col("n_regionkey") / 2), 7).alias("e"))


@query("normal_rand", "SELECT true AS many, true AS mean_near, true AS sd_near")
def normal_rand(spark, sf_dir):
    """20,000 numbers of a mean of 5 and a deviation of 3: both must be met within five standard errors."""
    got = numbers.normal_rand(spark, 20_000, 5.0, 3.0, seed=11).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s"))
    return got.select((F.col("n") == 20_000).alias("many"), (F.abs(F.col("m") - 5) < 5 * 3 / 20_000**0.5).alias("mean_near"), (F.abs(F.col("s") - 3) < 5 * 3 / 40_000**0.5).alias("sd_near"))

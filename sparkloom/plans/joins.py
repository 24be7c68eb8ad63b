"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as ops
from .registry import load, query, sql

sql("theta_join", "SELECT n.n_nationkey AS n, r.r_regionkey AS r FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey")
sql("cross_join", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a CROSS JOIN region b")
sql("hash_join_inner", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
sql("merge_join_hint", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderstatus FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE o_totalprice > 150000", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE o_totalprice > 150000")
sql("left_outer_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
sql("full_outer_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 50")
sql("right_join", "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql("left_join_null", "SELECT p_partkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48) l ON p_partkey = l_partkey WHERE l_partkey IS NULL")
sql("natural_join", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) y")
sql("self_join_range", "SELECT a.s_suppkey AS a, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal >= b.s_acctbal GROUP BY a.s_suppkey")
# Spark turns a correlated ORDER BY .. LIMIT into row numbers without an order after a sort of the whole table, and the shuffle between
# them mixes the rows; so the numbers are given with the order here, and each task keeps two rows a customer before the shuffle
sql(
    "lateral_topn",
    """SELECT c_custkey, o_orderkey FROM customer, LATERAL (
         SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM orders)
         WHERE o_custkey = c_custkey AND place <= 2) t""",
    "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
)
sql(
    "star_join",
    """SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)


@query(
    "asof_join",
    """WITH q AS (SELECT user_id, ts, max(event_id) AS quote FROM events WHERE event_id % 3 = 0 GROUP BY user_id, ts)
       SELECT e.event_id, q.quote FROM (SELECT * FROM events WHERE event_id % 3 <> 0) e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts >= q.ts""",
)
def asof_join(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    quotes = events.where("event_id % 3 = 0").groupBy("user_id", "ts").agg(F.max("event_id").alias("quote"))
    return ops.asof_join(events.where("event_id % 3 <> 0"), quotes, "user_id", "ts", "ts", ["quote"]).select("event_id", "quote")


@query(
    "interval_join",
    """SELECT a.p_partkey AS part, b.s_suppkey AS supp FROM part a JOIN supplier b ON a.p_partkey >= b.s_suppkey * 17 AND a.p_partkey < b.s_suppkey * 17 + 40""",
)
def interval_join(spark, sf_dir):
    points = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"))
    spans = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), (F.col("s_suppkey") * 17).alias("lo"), (F.col("s_suppkey") * 17 + 40).alias("hi"))
    return ops.interval_join(points, spans, "part", "lo", "hi", 64).select("part", "supp")


@query(
    "geo_distance_join",
    """WITH p AS (SELECT s_suppkey AS k, ((s_suppkey * 37) % 100)::DOUBLE AS x, ((s_suppkey * 91) % 100)::DOUBLE AS y FROM supplier)
       SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k < b.k AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6""",
)
def geo_distance_join(spark, sf_dir):
    """Points in cells of the radius' size; each looks into the cells around its own."""
    reach = 6
    p = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37) % 100).cast("double").alias("x"), ((F.col("s_suppkey") * 91) % 100).cast("double").alias("y"))
    cell = lambda c: F.floor(F.col(c) / reach)
    a = p.select(F.col("k").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = p.select(F.col("k").alias("b"), "x", "y", around.alias("dx")).select("*", around.alias("dy"))
    b = b.select("b", "x", "y", (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))
    near = F.sqrt((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2) <= reach
    return a.join(b, ["cx", "cy"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

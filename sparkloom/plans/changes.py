"""Changes of tables, samples of blocks and rows, procedures, plans as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import dml
from ..operators import relational as ops
from .registry import load, query, sql


def _accounts(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))


@query("insert_returning", "SELECT c_custkey + 1000000 AS k, 0.0::DOUBLE AS v, c_mktsegment AS s FROM customer WHERE c_acctbal < 0")
def insert_returning(spark, sf_dir):
    t = _accounts(spark, sf_dir)
    return dml.insert(t, t.where("v < 0").select((F.col("k") + 1000000).alias("k"), "s"), {"v": F.lit(0.0)})[1]


@query("update_returning", "SELECT c_custkey AS k, round(c_acctbal * 2, 4) AS v, c_mktsegment AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
def update_returning(spark, sf_dir):
    return dml.update(_accounts(spark, sf_dir), {"v": F.round(F.col("v") * 2, 4)}, F.col("s") == "BUILDING")[1]


@query("delete_rest", "SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY', true)")
def delete_rest(spark, sf_dir):
    """A null condition deletes nothing."""
    return dml.delete(_accounts(spark, sf_dir), F.nullif(F.col("s"), F.lit("BUILDING")) == "MACHINERY")[0]


@query(
    "on_conflict_update",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.v WHEN b.k IS NULL THEN a.v ELSE round(a.v + b.v, 4) END AS v, coalesce(a.s, b.s) AS s
       FROM (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer) a FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS v, 'new' AS s FROM supplier) b ON a.k = b.k""",
)
def on_conflict_update(spark, sf_dir):
    new = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("v"), F.lit("new").alias("s"))
    return dml.insert_on_conflict(_accounts(spark, sf_dir), new, ["k"], {"v": F.round(F.col("old.v") + F.col("excluded.v"), 4)})[0]


@query("on_conflict_nothing", "SELECT s_suppkey * 20 AS k FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def on_conflict_nothing(spark, sf_dir):
    new = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("k"))
    return dml.insert_on_conflict(_accounts(spark, sf_dir), new.unionByName(new), ["k"])[1].select("k")


@query(
    "merge_branches",
    """SELECT CASE WHEN b.k IS NULL THEN 'UPDATE' WHEN a.k IS NULL THEN 'INSERT' WHEN b.v < 0 THEN 'DELETE' ELSE 'UPDATE' END AS merge_action, coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 0 WHEN a.k IS NULL THEN b.v WHEN b.v < 0 THEN a.v ELSE b.v END::DOUBLE AS v
       FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS v FROM supplier) b ON a.k = b.k""",
)
def merge_branches(spark, sf_dir):
    t = _accounts(spark, sf_dir).select("k", "v")
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("v"))
    branches = [ops.When("matched", "delete", condition=F.col("s.v") < 0), ops.When("matched", "update", {"v": F.col("s.v")}), ops.When("unmatched", "insert"), ops.When("orphan", "update", {"v": F.lit(0.0)})]
    return ops.merge(t, s, ["k"], branches, returning=True)


@query("refresh_view", "SELECT o_orderstatus AS s, count(*) AS n, 2 AS version FROM orders GROUP BY o_orderstatus")
def refresh_view(spark, sf_dir):
    rows = load(spark, sf_dir, "orders")
    view = dml.MaterializedView(spark, "orders_by_status", lambda: rows.groupBy(F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    view.refresh(with_data=False)
    view.refresh()
    return spark.table("orders_by_status").withColumn("version", F.lit(view.version))


@query("procedure_call", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey HAVING count(*) >= 2")
def procedure_call(spark, sf_dir):
    def begin(s):
        load(s, sf_dir, "orders").createOrReplaceTempView("orders")

    steps = [begin, "CREATE OR REPLACE TEMPORARY VIEW big_orders AS SELECT o_custkey FROM orders WHERE o_totalprice > 150000", "SELECT o_custkey, count(*) AS n FROM big_orders GROUP BY o_custkey HAVING count(*) >= :least"]
    return dml.call(spark, steps, least=2)


@query("sample_system", "SELECT true AS of_table, true AS whole_blocks, true AS some")
def sample_system(spark, sf_dir):
    """TABLESAMPLE SYSTEM: whole blocks (of 100 keys) by a hash of the block and a seed."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey").withColumn("block", F.floor(F.col("o_orderkey") / 100))
    got = numbers.sample_blocks(rows, "block", 30.0, seed=5)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    kept = got.groupBy("block").agg(F.count(F.lit(1)).alias("m")).join(sizes, "block")
    total = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = kept.agg(F.bool_and(F.col("m") <= F.col("n")).alias("of_table"), F.bool_and(F.col("m") == F.col("n")).alias("whole_blocks"), F.count(F.lit(1)).alias("c"))
    return out.select("of_table", "whole_blocks", ((F.col("c") > 0) & (F.col("c") < total)).alias("some"))


sql("sample_rows", "SELECT count(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (100 ROWS)) t", "SELECT least(count(*), 100) AS n FROM orders")
sql("similar_between", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN least(30, 15) AND greatest(30, 15) AND NOT l_linenumber BETWEEN greatest(2, 5) AND least(2, 5)", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 15 AND 30 AND NOT l_linenumber BETWEEN 5 AND 2")
sql("srf_after_window", "SELECT k, n, explode(sequence(1, 2)) AS i FROM (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) t ORDER BY k, n, i", "SELECT k, n, i::INT AS i FROM (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) t, range(1, 3) r(i)")
sql(
    "hypothetical_dist",
    "SELECT l_returnflag, round(count_if(l_quantity < 25) / count(*), 8) AS percent_rank_25, round((count_if(l_quantity <= 25) + 1) / (count(*) + 1), 8) AS cume_dist_25 FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(count(*) FILTER (WHERE l_quantity < 25) / count(*), 8) AS percent_rank_25, round((count(*) FILTER (WHERE l_quantity <= 25) + 1) / (count(*) + 1), 8) AS cume_dist_25 FROM lineitem GROUP BY l_returnflag",
)


@query("explain_plan", "SELECT true AS scans, true AS prunes, true AS pushes")
def explain_plan(spark, sf_dir):
    """EXPLAIN as rows: the physical plan must show the pushed filter and only the columns that are read."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    text = spark.sql("EXPLAIN FORMATTED SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    p = F.col("plan")
    return text.select(p.contains("Scan parquet").alias("scans"), (p.contains("ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>")).alias("prunes"), p.contains("PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]").alias("pushes"))


@query("bloom_filter", "SELECT count(*) AS n, 0 AS missed, true AS few_more FROM orders WHERE o_custkey % 50 = 0")
def bloom_filter(spark, sf_dir):
    """A Bloom filter over keys: no member is missed, and few others pass."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = numbers.bloom_bits(rows.where("o_custkey % 50 = 0"), "o_custkey", 1 << 12)
    passed = rows.where(numbers.bloom_may_hold(held.scalar(), F.col("o_custkey"), 1 << 12))
    member = F.col("o_custkey") % 50 == 0
    whole = rows.where(member).agg(F.count(F.lit(1)).alias("n")).scalar()
    got = passed.agg(F.count_if(member).alias("n"), F.count(F.lit(1)).alias("m"))
    return got.select("n", (whole - F.col("n")).cast("int").alias("missed"), (F.col("m") <= F.col("n") + whole * 5 + 100).alias("few_more"))

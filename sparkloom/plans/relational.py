"""Scans, row sources, projection, filters, predicates, sort, limit, distinct and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as ops
from ..sources import files
from .registry import load, query, sql

# ---- scans and row sources

sql("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount > 0.05")
sql("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 7, 33, 1000)")
sql("const_select", "SELECT 1 AS one, 'a' AS letter WHERE 1 = 1")
sql("values_join", "SELECT r_name, v.tag FROM region JOIN (VALUES (0, 'x'), (2, 'y'), (9, 'z')) AS v(k, tag) ON r_regionkey = v.k")
sql("derived_table", "SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s, o_custkey FROM orders WHERE o_totalprice > 1000) t GROUP BY s")
sql(
    "cte_reuse",
    """WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey)
       SELECT a.k, a.n FROM t a JOIN (SELECT max(n) AS m FROM t) b ON a.n = b.m""",
)
sql(
    "recursive_union_all",
    "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
)
sql("generate_series", "SELECT explode(sequence(1, 20, 3)) AS n", "SELECT unnest(generate_series(1, 20, 3))::INTEGER AS n")
sql(
    "unnest_ordinality",
    "SELECT vec_id, pos + 1 AS ord, x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x",
    "SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER AS ord, unnest(embedding) AS x FROM embeddings",
)
sql("tablesample", "SELECT * FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)", rows_only=True)
sql(
    "sample_hash",
    "SELECT o_orderkey FROM orders WHERE pmod(o_orderkey * 2654435761, 100) < 10",
    "SELECT o_orderkey FROM orders WHERE (o_orderkey * 2654435761) % 100 < 10",
)


@query(
    "recursive_union_distinct",
    """WITH RECURSIVE r(a) AS (SELECT 1::BIGINT UNION SELECT (a * 3) % 50 FROM r) SELECT a FROM r""",
)
def recursive_union_distinct(spark, sf_dir):
    start = spark.range(1, 2).select(F.col("id").alias("a"))
    return ops.recursive_union(start, lambda delta: delta.select(((F.col("a") * 3) % 50).alias("a")))


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def csv_roundtrip(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return files.through_csv(rows, header=True, sep="|", null_value="\\N")


@query("ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ctas(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return files.create_table_as(rows, "nations_by_region")


# ---- projection, filter, conditional and predicate operators

sql("projection_expr", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) || '-' || l_linestatus AS code FROM lineitem")
sql("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 1000) OR NOT (o_custkey > 100 OR o_orderpriority IS NULL)")
sql(
    "case_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, CASE WHEN 1 = 1 THEN 1 ELSE 1 / 0 END AS lazy FROM orders""",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, 1.0::DOUBLE AS lazy FROM orders""",
)
sql("coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'none') AS status, nullif(o_custkey, 1) AS c FROM orders")
sql("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25, NULL) AS hi, least(l_quantity, 25) AS lo FROM lineitem", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, 25) AS hi, least(l_quantity, 25) AS lo FROM lineitem")
sql("is_distinct_from", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
sql("in_list", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_returnflag NOT IN ('A')")
sql(
    "any_all_array",
    "SELECT vec_id, exists(embedding, x -> x > 0.3) AS any_big, forall(embedding, x -> x < 0.5) AS all_small FROM embeddings",
    "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_big, len(list_filter(embedding, lambda x: NOT (x < 0.5))) = 0 AS all_small FROM embeddings",
)
sql("between_range", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_quantity BETWEEN least(30, 15) AND greatest(30, 15)")
sql("row_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, CAST(p_size AS BIGINT) FROM part)")
sql("like_pattern", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_brand NOT LIKE 'Brand#_2' AND p_type LIKE '%' ESCAPE '!'")
sql("ilike_pattern", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g'")
sql("regex_match", "SELECT c_custkey FROM customer WHERE c_name RLIKE '0(1|2)[0-9]$' AND NOT c_mktsegment RLIKE '^MACH'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0(1|2)[0-9]$') AND NOT regexp_matches(c_mktsegment, '^MACH')")
sql("is_json", "SELECT event_id, try_parse_json(props) IS NOT NULL AS ok, try_parse_json(substring(props, 1, 4)) IS NOT NULL AS cut_ok FROM events", "SELECT event_id, props IS NOT NULL AND json_valid(props) AS ok, props IS NOT NULL AND json_valid(substring(props, 1, 4)) AS cut_ok FROM events")
sql("exists_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("not_exists_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("not_in_null", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)")
sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
sql("correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
sql(
    "interval_overlap",
    """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
       AND a.o_orderdate < b.o_orderdate + INTERVAL '5' DAY AND b.o_orderdate < a.o_orderdate + INTERVAL '5' DAY""",
)
sql("collate_ci", "SELECT max(c_name COLLATE UTF8_LCASE) AS m, count(*) AS n FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT max(c_name) AS m, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")

# ---- sort, limit, distinct

sql("sort_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100")
sql("sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40")
sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@query("limit_with_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 10")
def limit_with_ties(spark, sf_dir):
    return ops.limit_with_ties(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10)


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ops.distinct_on(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


sql("union_sorted", "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) t ORDER BY k")

# ---- set operations

sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# ---- set-returning projection

sql("srf_lockstep", "SELECT inline(arrays_zip(a, b)) FROM (SELECT sequence(1, 3) AS a, sequence(10, 50, 10) AS b) t", "SELECT unnest(generate_series(1, 3))::INTEGER AS a, unnest(generate_series(10, 50, 10))::INTEGER AS b")
sql(
    "srf_nested",
    "SELECT n_nationkey, i, j FROM nation LATERAL VIEW explode(sequence(1, 2)) x AS i LATERAL VIEW explode(sequence(i, 3)) y AS j",
    "SELECT n_nationkey, i::INTEGER AS i, j::INTEGER AS j FROM nation, range(1, 3) x(i), range(1, 4) y(j) WHERE j >= i",
)
sql("unnest_array", "SELECT vec_id, explode(embedding) AS x FROM embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
sql(
    "cube_over_srf",
    "SELECT r_name, i, count(*) AS n FROM (SELECT r_name, explode(sequence(1, 2)) AS i FROM region) t GROUP BY CUBE (r_name, i)",
    "SELECT r_name, i, count(*) AS n FROM (SELECT r_name, i::INTEGER AS i FROM region, range(1, 3) x(i)) t GROUP BY CUBE (r_name, i)",
)

# ---- DML


MERGE_ORACLE = """
SELECT coalesce(n.k, o.o_custkey) AS k, coalesce(o.total, 0) + coalesce(n.add, 0) AS total
FROM (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey) o
FULL JOIN (SELECT c_custkey AS k, 100 AS add FROM customer WHERE c_acctbal < 0) n ON n.k = o.o_custkey
"""


@query("merge_upsert", MERGE_ORACLE)
def merge_upsert(spark, sf_dir):
    target = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("total"))
    source = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit(100).cast("long").alias("total"))
    return ops.merge_upsert(target, source, ["k"], update={"total": F.col("t.total") + F.col("s.total")})

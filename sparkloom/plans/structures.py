"""Arrays, maps, JSON, XML, label trees, pivots and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structures as s
from ..operators import relational as ops
from .registry import load, query, sql

sql(
    "array_basic",
    """SELECT n_nationkey, a[0] AS first, element_at(a, -1) AS last, array_join(slice(a, 2, 2), ',') AS mid, array_join(concat(a, array(99)), ',') AS more, CAST(array_position(a, n_regionkey) AS INT) AS at,
       array_join(array_remove(a, 7), ',') AS without, CAST(size(a) AS INT) AS n FROM (SELECT *, array(n_nationkey, 7, n_regionkey) AS a FROM nation) t""",
    """SELECT n_nationkey, a[1] AS first, a[-1] AS last, array_to_string(a[2:3], ',') AS mid, array_to_string(list_append(a, 99), ',') AS more, coalesce(list_position(a, n_regionkey), 0)::INT AS at,
       array_to_string(list_filter(a, lambda x: x <> 7), ',') AS without, len(a)::INT AS n FROM (SELECT *, [n_nationkey, 7, n_regionkey] AS a FROM nation) t""",
)
sql(
    "array_contains_overlap",
    """SELECT n_nationkey, size(array_except(array(n_regionkey, 7), array(1, 2, 7))) = 0 AS contained, arrays_overlap(array(n_regionkey, n_nationkey), array(2, 3, 20)) AS overlap FROM nation""",
    """SELECT n_nationkey, list_has_all([1, 2, 7], [n_regionkey, 7]) AS contained, list_has_any([n_regionkey, n_nationkey], [2, 3, 20]) AS overlap FROM nation""",
)


@query(
    "intarray_ops",
    """SELECT n_nationkey, array_to_string(list_sort(list_distinct([n_regionkey, 3, n_nationkey, 3])), ',') AS sorted, array_to_string(list_sort(list_distinct(list_concat([n_regionkey, 1], [2, 3]))), ',') AS united,
       array_to_string(list_sort(list_filter([0, 1, 2, 3, 4], lambda x: x <> n_regionkey)), ',') AS less, 3 AS n FROM nation""",
)
def intarray_ops(spark, sf_dir):
    r, n = F.col("n_regionkey"), F.col("n_nationkey")
    ordered = F.sort_array(F.array(r, F.lit(3), n, F.lit(3)))
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", F.array_join(s.uniq(ordered), ",").alias("sorted"), F.array_join(F.sort_array(F.array_union(F.array(r, F.lit(1)), F.array(F.lit(2), F.lit(3)))), ",").alias("united"),
        F.array_join(F.array_remove(F.array(*[F.lit(i) for i in range(5)]), r), ",").alias("less"), F.size(F.array(r, n, F.lit(1))).alias("n"),
    )


sql(
    "map_ops",
    """SELECT n_nationkey, m['r'] AS r, map_contains_key(m, 'z') AS z, array_join(sort_array(map_keys(map_concat(m, map('x', 'y')))), ',') AS ks, array_join(sort_array(map_values(map_filter(m, (k, v) -> k <> 'n'))), ',') AS vs
       FROM (SELECT n_nationkey, map('n', n_name, 'r', CAST(n_regionkey AS STRING)) AS m FROM nation) t""",
    "SELECT n_nationkey, n_regionkey::VARCHAR AS r, false AS z, 'n,r,x' AS ks, n_regionkey::VARCHAR AS vs FROM nation",
)
sql("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, variant_get(parse_json(props), '$.k', 'bigint') AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT AS v FROM events")
sql("json_exists", "SELECT event_id, get_json_object(props, '$.k') IS NOT NULL AS has_k, array_contains(json_object_keys(props), 'zz') AS has_zz FROM events", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz FROM events")
sql("json_explode", "SELECT event_id, t.key, CAST(t.value AS STRING) AS value FROM events, LATERAL variant_explode(parse_json(props)) AS t", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) t")
sql("json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name, 'list', array(1, n_regionkey))) AS j FROM nation", "SELECT n_nationkey, json_object('id', n_nationkey, 'name', n_name, 'list', [1, n_regionkey])::VARCHAR AS j FROM nation")
sql("xpath_extract", "SELECT n_nationkey, xpath_string(x, '/n/name') AS name, xpath_int(x, '/n/@id') AS id, xpath_boolean(x, '/n/region') AS has FROM (SELECT n_nationkey, concat('<n id=\"', n_nationkey, '\"><name>', n_name, '</name></n>') AS x FROM nation) t", "SELECT n_nationkey, n_name AS name, n_nationkey AS id, false AS has FROM nation")


@query(
    "ltree_ops",
    """SELECT n_nationkey, 3 AS nlevel, 'world.r' || n_regionkey AS parent, n_regionkey = 2 AS below_r2, n_nationkey::VARCHAR LIKE '1%' AS ones FROM nation""",
)
def ltree_ops(spark, sf_dir):
    path = F.concat(F.lit("world.r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", path.alias("p"))
    return n.select("n_nationkey", F.size(F.split("p", r"\.")).alias("nlevel"), s.subpath(F.col("p"), 0, 2).alias("parent"), s.is_ancestor(F.lit("world.r2"), F.col("p")).alias("below_r2"), s.lquery(F.col("p"), "*.n1*").alias("ones"))


@query("crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def crosstab(spark, sf_dir):
    return ops.crosstab(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.count(F.lit(1)), ["F", "O", "P"]).na.fill(0)


@query("crosstab_positional", "SELECT n_regionkey, min(n_name) FILTER (WHERE i = 1) AS c1, min(n_name) FILTER (WHERE i = 2) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey")
def crosstab_positional(spark, sf_dir):
    from pyspark.sql import Window as W

    n = load(spark, sf_dir, "nation").withColumn("i", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return ops.crosstab(n.where("i <= 2"), "n_regionkey", "i", F.first("n_name"), [1, 2]).withColumnsRenamed({"1": "c1", "2": "c2"})


@query(
    "connectby",
    """WITH RECURSIVE e AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 1 THEN c_custkey // 3 + 0 END AS p FROM customer),
       t AS (SELECT 1::BIGINT AS key, 0 AS level, '1' AS branch UNION ALL SELECT e.k, t.level + 1, t.branch || '~' || e.k FROM e JOIN t ON e.p = t.key) SELECT key, level, branch FROM t""",
)
def connectby(spark, sf_dir):
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey > 1 THEN c_custkey div 3 END AS p")
    return s.connectby(c, "k", "p", 1)


@query("enum_order", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 0 END::BIGINT AS r FROM orders")
def enum_order(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", s.enum_rank(F.col("o_orderstatus"), ["O", "P", "F"]).alias("r"))

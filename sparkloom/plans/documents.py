"""JSON and XML beyond extraction: kinds, changes, path filters, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as d
from .registry import load, query, sql


@query(
    "json_kinds",
    """SELECT event_id, 'object' AS a, 'array' AS b, 'scalar' AS c, NULL::VARCHAR AS bad, true AS one, false AS two, json_extract_string(props, '$.k')::BIGINT >= 0 AS known FROM events""",
)
def json_kinds(spark, sf_dir):
    p = F.col("props")
    return load(spark, sf_dir, "events").select(
        "event_id", d.json_kind(p).alias("a"), d.json_kind(F.concat(F.lit("["), p, F.lit("]"))).alias("b"), d.json_kind(F.lit("12.5")).alias("c"), d.json_kind(F.substring(p, 1, 4)).alias("bad"),
        d.json_unique_keys(p).alias("one"), d.json_unique_keys(F.lit('{"a": 1, "a": 2}')).alias("two"), (F.get_json_object(p, "$.k").cast("long") >= 0).alias("known"),
    )


@query("json_set", """SELECT event_id, '{"k":' || (json_extract_string(props, '$.k')::BIGINT + 1) || '}' AS changed, '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' AS added FROM events""")
def json_set(spark, sf_dir):
    p, k = F.col("props"), F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select("event_id", d.json_set(p, "k", (k + 1).cast("string")).alias("changed"), d.json_set(p, "t", F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("added"))


@query(
    "jsonpath_filter",
    """SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_totalprice > 100000) > 0""",
)
def jsonpath_filter(spark, sf_dir):
    """The orders of a customer as a JSON document, then `$.o[*] ? (@.t > 100000).k`."""
    each = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("t"))))
    docs = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(each.alias("o"))).alias("j"))
    found = docs.select("o_custkey", d.json_path_filter(F.col("j"), "o", "t", ">", "100000", "k").alias("ks")).where(F.size("ks") > 0)
    return found.select("o_custkey", F.array_join("ks", ",").alias("big"))


@query("json_pretty", """SELECT event_id, '{' || chr(10) || '    "k": ' || json_extract_string(props, '$.k') || ',' || chr(10) || '    "t": "' || event_type || '"' || chr(10) || '}' AS p FROM events""")
def json_pretty(spark, sf_dir):
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("t")))
    return load(spark, sf_dir, "events").select("event_id", d.json_pretty(j).alias("p"))


sql(
    "json_table",
    """SELECT e.event_id, t.pos AS ord, CAST(t.value AS BIGINT) AS v FROM events e, LATERAL variant_explode(parse_json(concat('[', get_json_object(e.props, '$.k'), ',', e.event_id, ']'))) AS t""",
    """SELECT event_id, i::INT AS ord, CASE i WHEN 0 THEN json_extract_string(props, '$.k')::BIGINT ELSE event_id END AS v FROM events, range(0, 2) r(i)""",
)
sql(
    "json_agg_nulls",
    """SELECT n_regionkey, to_json(transform(sort_array(collect_list(struct(n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS n))), x -> coalesce(x.n, '-'))) AS every, to_json(array_compact(transform(sort_array(collect_list(struct(n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS n))), x -> x.n))) AS present
       FROM nation GROUP BY n_regionkey""",
    """SELECT n_regionkey, to_json(list(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '-' END ORDER BY n_nationkey))::VARCHAR AS every, to_json(coalesce(list(n_name ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 0), []))::VARCHAR AS present FROM nation GROUP BY n_regionkey""",
)
sql(
    "win_json_array",
    "SELECT n_nationkey, to_json(sort_array(collect_list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END) OVER (PARTITION BY n_regionkey))) AS j FROM nation",
    "SELECT n_nationkey, to_json(coalesce(list_sort(list(n_name) FILTER (WHERE n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey)), []))::VARCHAR AS j FROM nation",
)
sql(
    "xml_agg",
    "SELECT n_regionkey, concat('<r>', array_join(transform(sort_array(collect_list(n_name)), x -> concat('<n>', x, '</n>')), ''), '</r>') AS x FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, '<r>' || string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) || '</r>' AS x FROM nation GROUP BY n_regionkey",
)


@query("xml_table", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS ord, n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def xml_table(spark, sf_dir):
    """A document a region, taken apart into a row for each of its nodes."""
    node = F.concat(F.lit('<n id="'), "n_nationkey", F.lit('"><name>'), "n_name", F.lit("</name></n>"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", node.alias("x")))), lambda s: s["x"])
    docs = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(each, ""), F.lit("</r>")).alias("x"))
    rows = docs.select("n_regionkey", F.explode(d.xpath_rows(F.col("x"), "/r/n", {"id": "@id", "name": "name"})).alias("t"))
    return rows.select("n_regionkey", "t.ord", "t.id", "t.name")

"""Aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .registry import load, query, sql

MONEY = "CAST({} AS DECIMAL(18,2))"
PRICE, DISC, QTY = MONEY.format("l_extendedprice"), "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_quantity AS DECIMAL(18,2))"

sql(
    "pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, CAST(sum({QTY}) AS DOUBLE) AS sum_qty, CAST(sum({PRICE}) AS DOUBLE) AS sum_base_price,
        CAST(sum({PRICE} * (1 - {DISC})) AS DOUBLE) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql("agg_group_by", f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum({MONEY.format('o_totalprice')}) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus")
sql("group_only", "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
sql("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) > 100")
sql("having_no_group", "SELECT count(*) AS n FROM orders HAVING max(o_orderkey) > 0")
sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("array_agg_ordered", "SELECT o_custkey, array_join(transform(sort_array(collect_list(struct(o_totalprice, o_orderkey))), x -> CAST(x.o_orderkey AS STRING)), ',') AS ks FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice, o_orderkey) AS ks FROM orders GROUP BY o_custkey")
sql("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_linestatus")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g1, CAST(grouping(o_orderpriority) AS INT) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("bool_aggs", "SELECT c_nationkey, bool_and(c_acctbal > 0) AS all_pos, bool_or(c_acctbal < 0) AS any_neg FROM customer GROUP BY c_nationkey")
sql("string_agg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("array_agg", "SELECT n_regionkey, array_join(sort_array(collect_list(CAST(n_nationkey AS STRING))), ',') AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey::VARCHAR)), ',') AS ks FROM nation GROUP BY n_regionkey")
sql("percentiles", "SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 4) AS c FROM lineitem GROUP BY l_returnflag")
sql("mode_agg", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_custkey % 3) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_custkey % 3) AS m FROM orders GROUP BY o_orderstatus")
sql("hypothetical_rank", "SELECT l_returnflag, count_if(l_quantity < 25) + 1 AS rank_25, count(DISTINCT CASE WHEN l_quantity < 25 THEN l_quantity END) + 1 AS dense_25 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity < 25) + 1 AS rank_25, count(DISTINCT CASE WHEN l_quantity < 25 THEN l_quantity END) + 1 AS dense_25 FROM lineitem GROUP BY l_returnflag")
sql(
    "stat_aggs",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cs,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_returnflag""",
)
sql("bit_aggs", "SELECT c_mktsegment, bit_and(c_nationkey) AS a, bit_or(c_nationkey) AS o, bit_xor(c_nationkey) AS x FROM customer GROUP BY c_mktsegment")
sql("json_array_agg", "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, to_json(list_sort(array_agg(n_name)))::VARCHAR AS j FROM nation GROUP BY n_regionkey")
sql("json_object_agg", "SELECT n_regionkey, to_json(map_from_entries(sort_array(collect_list(struct(CAST(n_nationkey AS STRING), n_name))))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, to_json(map_from_entries(list_sort(list(struct_pack(k := k, v := n_name)))))::VARCHAR AS j FROM (SELECT n_regionkey, n_nationkey::VARCHAR AS k, n_name FROM nation) GROUP BY n_regionkey")
sql("approx_distinct", "SELECT l_returnflag, approx_count_distinct(l_partkey) AS n FROM lineitem GROUP BY l_returnflag", rows_only=True)
sql("approx_percentile", "SELECT l_returnflag, approx_percentile(l_extendedprice, 0.9) AS p FROM lineitem GROUP BY l_returnflag", rows_only=True)
sql("any_value_agg", "SELECT n_regionkey, any_value(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
sql("min_max_by", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")


@query("uda_weighted_avg", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS w FROM lineitem GROUP BY l_returnflag")
def uda_weighted_avg(spark, sf_dir):
    """A user-defined aggregate by its parts: transition and combination are sums, so it is partial before the shuffle."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("w"))


@query("uda_pandas_median", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m FROM customer GROUP BY c_mktsegment")
def uda_pandas_median(spark, sf_dir):
    """An aggregate that has no combination step, as a grouped pandas function."""

    @F.pandas_udf("double")
    def middle(x: pd.Series) -> float:
        return float(x.median())

    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(middle("c_acctbal"), 4).alias("m"))

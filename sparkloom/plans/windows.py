"""Window functions and frames; those that Spark has no syntax for are re-expressed."""

from __future__ import annotations

from .registry import sql

P = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"

sql("win_row_number", f"SELECT o_orderkey, row_number() OVER ({P}) AS rn FROM orders")
sql("win_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem")
sql("win_dense_rank", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1) OVER ({P}) AS prev, lead(o_orderkey, 2, -1) OVER ({P}) AS next2 FROM orders")
sql("win_over_agg", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("win_ntile", f"SELECT o_orderkey, ntile(4) OVER ({P}) AS q FROM orders", f"SELECT o_orderkey, ntile(4) OVER ({P}) AS q FROM orders")
sql("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({P}) AS f, last_value(o_orderkey) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({P}) AS second FROM orders")
sql("win_dist", f"SELECT o_orderkey, round(percent_rank() OVER ({P}), 8) AS p, round(cume_dist() OVER ({P}), 8) AS c FROM orders")
sql("win_running_sum", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM orders")
sql("win_range_frame", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem")
sql("win_named", "SELECT o_orderkey, count(*) OVER w AS n, min(o_orderkey) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)")
sql(
    "win_groups_frame",
    """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n
       FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS g FROM lineitem) t""",
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM lineitem",
)
sql(
    "win_exclude",
    f"SELECT o_orderkey, CAST(sum(CAST(o_custkey AS BIGINT)) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - o_custkey AS BIGINT) AS s FROM orders",
    f"SELECT o_orderkey, coalesce(sum(o_custkey) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 0)::BIGINT AS s FROM orders",
)
sql(
    "win_json_agg",
    "SELECT n_nationkey, array_join(sort_array(collect_list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END) OVER (PARTITION BY n_regionkey)), ',') AS j FROM nation",
    "SELECT n_nationkey, coalesce(array_to_string(list_sort(list(n_name) FILTER (WHERE n_nationkey % 2 = 0) OVER (PARTITION BY n_regionkey)), ','), '') AS j FROM nation",
)

"""The top rows of each customer, on rows that hold nulls, ties and repeated keys, and in a plan that no shuffle can mix up."""

import re
from collections import Counter

import duckdb

from sparkloom.catalog import ORACLE_SQL, QUERIES


def small_tables(spark, folder):
    spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    orders = [(10, 1, 5.0), (11, 1, 7.0), (12, 1, 7.0), (13, 1, 7.0), (None, 2, 9.0), (21, 2, 9.0), (20, 2, 9.0), (30, 3, None), (31, 3, None), (None, 3, None), (32, 3, -1.0), (40, None, 1.0), (50, 9, 1.0), (33, 4, float("nan")), (34, 4, 0.0), (35, 4, -0.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(5).write.parquet(f"{folder}/orders.parquet")


def test_lateral_topn_on_nulls_ties_and_repeated_customers(spark, tmp_path):
    small_tables(spark, tmp_path)
    c = duckdb.connect()
    for t in ("customer", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = Counter(map(tuple, QUERIES["lateral_topn"](spark, str(tmp_path)).collect()))
    assert got == Counter(c.sql(ORACLE_SQL["lateral_topn"]).fetchall())
    assert got == Counter({(1, 11): 2, (1, 12): 2, (2, 20): 1, (2, 21): 1, (3, 32): 1, (3, 30): 1, (4, 33): 1, (4, 34): 1})


def test_lateral_topn_numbers_rows_in_an_order_of_their_own(spark, sf_dir):
    plan = QUERIES["lateral_topn"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    assert windows and all("o_totalprice" in w and "o_orderkey" in w for w in windows)
    assert "rangepartitioning" not in plan and "WindowGroupLimit" in plan

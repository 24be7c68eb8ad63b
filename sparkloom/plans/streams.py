"""Event windows in batch and as streams, change feeds, functions and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import relational as ops
from ..streaming import events as st
from .registry import load, query, sql

TUMBLING = "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
SLIDING = "SELECT (epoch(time_bucket(INTERVAL '30 minutes', ts)) - i * 1800)::BIGINT AS start, count(*) AS n FROM events, range(0, 2) r(i) GROUP BY 1"
SESSIONS = """SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, s"""


@query("tumbling_agg", TUMBLING)
def tumbling_agg(spark, sf_dir):
    return st.tumbling(load(spark, sf_dir, "events"), "1 hour")


@query("sliding_agg", SLIDING)
def sliding_agg(spark, sf_dir):
    return st.sliding(load(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("sessionize", SESSIONS)
def sessionize(spark, sf_dir):
    return st.sessions(load(spark, sf_dir, "events"), "6 hours")


@query("session_numbers", "SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6 hours' THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events) a")
def session_numbers(spark, sf_dir):
    return ops.sessionize(load(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600).select("event_id", "session")


@query("stream_tumbling", TUMBLING)
def stream_tumbling(spark, sf_dir):
    return st.run_to_end(st.tumbling(st.stream(spark, f"{sf_dir}/events.parquet"), "1 hour"), "complete")


@query("stream_sliding", SLIDING)
def stream_sliding(spark, sf_dir):
    return st.run_to_end(st.sliding(st.stream(spark, f"{sf_dir}/events.parquet"), "1 hour", "30 minutes"), "complete")


@query("stream_session", SESSIONS)
def stream_session(spark, sf_dir):
    return st.run_to_end(st.sessions(st.stream(spark, f"{sf_dir}/events.parquet"), "6 hours"), "complete")


@query("stream_batch_train")
def stream_batch_train(spark, sf_dir):
    """Running sums for a least-squares fit, updated by each micro-batch."""
    total = [0.0] * 5

    def step(batch, _):
        x, y = F.col("k"), F.col("value")
        rows = batch.select(F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
        got = rows.agg(F.count("k"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)).first()  # one row
        for i, v in enumerate(got):
            total[i] += float(v or 0)

    st.train_by_batch(st.stream(spark, f"{sf_dir}/events.parquet"), step)
    n, sx, sy, sxx, sxy = total
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx) if n * sxx != sx * sx else 0.0
    return spark.createDataFrame([(int(n), slope, (sy - slope * sx) / n if n else 0.0)], "n long, slope double, intercept double")


@query("cdc_latest", "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0")
def cdc_latest(spark, sf_dir):
    changes = load(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_id") % 7 == 0, "D").otherwise("U").alias("op"))
    return st.latest(changes, ["user_id"], "event_id").select("user_id", "value")


# ---- functions and table functions


@query("sql_udf", "SELECT c_custkey, c_acctbal * 2 + 1 AS x FROM customer")
def sql_udf(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_plus(a DOUBLE) RETURNS DOUBLE RETURN a * 2 + 1")
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, twice_plus(c_acctbal) AS x FROM customer")


@query("pandas_udf", "SELECT c_custkey, c_acctbal * 2 + 1 AS x FROM customer")
def pandas_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def f(a: pd.Series) -> pd.Series:
        return a * 2 + 1

    return load(spark, sf_dir, "customer").select("c_custkey", f("c_acctbal").alias("x"))


@query("udtf", "SELECT n_nationkey, i::INT AS i FROM nation, range(0, 3) r(i)")
def udtf(spark, sf_dir):
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("count_to", Count)
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, t.i FROM nation, LATERAL count_to(3) t")


@query("prepared", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def prepared(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000, "status": "F"})


sql("view_of_query", "WITH v AS (SELECT c_nationkey AS n, c_acctbal AS a FROM customer) SELECT n, count(*) AS k FROM v WHERE a > 0 GROUP BY n")

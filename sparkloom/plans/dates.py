"""Dates, times and time zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as d
from .registry import load, query, sql


@query(
    "age_fields",
    """SELECT o_orderkey, datepart('year', a)::INT AS y, datepart('month', a)::INT AS m, datepart('day', a)::INT AS d, epoch_us(a - to_years(datepart('year', a)::INT) - to_months(datepart('month', a)::INT) - to_days(datepart('day', a)::INT))::BIGINT AS us
       FROM (SELECT o_orderkey, age(TIMESTAMP '2001-03-15 12:30:00', o_orderdate) AS a FROM orders) t""",
)
def age_fields(spark, sf_dir):
    a = d.age(F.lit("2001-03-15 12:30:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return load(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", F.col("a.years").alias("y"), F.col("a.months").alias("m"), F.col("a.days").alias("d"), F.col("a.micros").alias("us"))


@query(
    "justify_interval",
    """SELECT l_orderkey, l_linenumber, (l_linenumber * 7) // 30 AS months, (l_linenumber * 7) % 30 AS days, l_quantity::BIGINT // 24 AS whole_days, (l_quantity::BIGINT % 24) * 3600000000 AS rest FROM lineitem""",
)
def justify_interval(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    j, h = d.justify_days(F.lit(0), F.col("l_linenumber") * 7), d.justify_hours(F.lit(0), F.col("l_quantity").cast("long") * 3_600_000_000)
    return l.select("l_orderkey", "l_linenumber", j["months"].alias("months"), j["days"].alias("days"), h["days"].alias("whole_days"), h["micros"].alias("rest"))


@query("is_finite", "SELECT n_nationkey, isfinite(CASE n_regionkey WHEN 0 THEN 'infinity'::DATE WHEN 1 THEN '-infinity'::DATE ELSE DATE '2024-02-29' END) AS ok FROM nation")
def is_finite(spark, sf_dir):
    x = F.when(F.col("n_regionkey") == 0, "9999-12-31").when(F.col("n_regionkey") == 1, "0001-01-01").otherwise("2024-02-29")
    return load(spark, sf_dir, "nation").select("n_nationkey", d.is_finite(x).alias("ok"))


@query(
    "iso_fields",
    """SELECT o_orderkey, isodow(o_orderdate)::INT AS isodow, isoyear(o_orderdate)::INT AS isoyear, millennium(o_orderdate)::INT AS millennium, floor(julian(o_orderdate::DATE))::INT AS julian,
       millisecond(o_orderdate)::BIGINT AS ms, microsecond(o_orderdate)::BIGINT AS us, hour(o_orderdate)::INT AS h FROM orders""",
)
def iso_fields(spark, sf_dir):
    t = F.col("o_orderdate")
    within = F.pmod(d.micros(t), F.lit(60_000_000))
    return load(spark, sf_dir, "orders").select("o_orderkey", d.iso_dow(t).alias("isodow"), d.iso_year(t).alias("isoyear"), d.millennium(t).alias("millennium"), d.julian(t).alias("julian"), F.floor(within / 1000).alias("ms"), within.alias("us"), F.hour(t).alias("h"))


@query("date_bin_origin", "SELECT event_id, epoch_us(time_bucket(INTERVAL '7 minutes', ts, TIMESTAMP '2020-02-11 00:00:03'))::BIGINT AS bin FROM events")
def date_bin_origin(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", d.micros(d.date_bin("7 minutes", F.col("ts"), "2020-02-11 00:00:03")).alias("bin"))


@query(
    "make_times",
    """SELECT n_nationkey, epoch_us(make_timestamp(2000 + n_nationkey, 1 + n_regionkey, 28, n_regionkey, 59, 1.5))::BIGINT AS ts, (n_regionkey * 3600 + n_nationkey * 60)::BIGINT * 1000000 + 250000 AS t,
       epoch_us(to_days(n_nationkey) + to_hours(n_regionkey))::BIGINT AS span, epoch_us(TIMESTAMP '2024-01-31 00:00:00' + to_months(n_regionkey + 1))::BIGINT AS clamped FROM nation""",
)
def make_times(spark, sf_dir):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    ts = F.make_timestamp_ntz(n + 2000, r + 1, F.lit(28), r, F.lit(59), F.lit(1.5))
    span = F.make_dt_interval(n, r)
    day = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    clamped = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), r + 1)
    return load(spark, sf_dir, "nation").select("n_nationkey", d.micros(ts).alias("ts"), d.make_time(r, n, F.lit(0.25)).alias("t"), d.micros(day + span).alias("span"), d.micros(clamped).alias("clamped"))


sql(
    "time_zones",
    "SELECT event_id, unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York')) AS ny, unix_micros(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo')) AS from_tokyo FROM events",
    "SELECT event_id, epoch_us(ts - INTERVAL '1 hour' * (CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END))::BIGINT AS ny, epoch_us(ts - INTERVAL '9 hours')::BIGINT AS from_tokyo FROM events",
)
sql(
    "current_times",
    "SELECT count(*) AS n, bool_and(now() = current_timestamp()) AS one_time, bool_and(current_date() = CAST(now() AS DATE)) AS one_day, bool_and(now() > TIMESTAMP '2020-01-01 00:00:00') AS late, bool_and(CAST(localtimestamp() AS DATE) = current_date()) AS local FROM region",
    "SELECT count(*) AS n, true AS one_time, true AS one_day, true AS late, true AS local FROM region",
)
sql(
    "to_date_number",
    "SELECT o_orderkey, CAST(to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS STRING) AS d, CAST(to_number(format_number(o_custkey, 0), '999,999,999') AS BIGINT) AS n, unix_micros(to_timestamp(date_format(o_orderdate, 'yyyyMMdd HHmmss'), 'yyyyMMdd HHmmss')) AS t FROM orders",
    "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS d, o_custkey AS n, epoch_us(date_trunc('second', o_orderdate))::BIGINT AS t FROM orders",
)

"""Bitemporal observations and cutoffs from the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.pit import WeeklyCalendar
from tideline.session import read_table


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as revisions of their order date's period; returned items are tombstones, ship dates are availability."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = read_table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.lit("orders").alias("source"), F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("observed_period_end"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("value"), F.col("l_shipdate").alias("available_at"),
        F.col("l_shipdate").cast("date").alias("vintage_date"), F.col("l_shipdate").alias("retrieved_at"), F.col("l_linenumber").alias("revision_seq"),
        F.sha2(key, 256).alias("raw_sha256"),
    )


OBS_SQL = """obs AS (SELECT 'orders' AS source, o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observed_period_end,
 CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS value, l_shipdate AS available_at, CAST(l_shipdate AS DATE) AS vintage_date, l_shipdate AS retrieved_at, l_linenumber AS revision_seq,
 sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round(l_extendedprice * 100) AS BIGINT))) AS raw_sha256
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def order_calendar(spark: SparkSession, sf_dir: str, hour: int = 21) -> WeeklyCalendar:
    """Friday cutoffs from the first order's week to the last order's week."""
    first, last = read_table(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")), F.max(F.col("o_orderdate").cast("date"))).first()
    friday = lambda d: d - dt.timedelta(days=d.weekday()) + dt.timedelta(days=4)
    start, end = friday(first), friday(last)
    return WeeklyCalendar(dt.datetime.combine(start, dt.time(hour)), (end - start).days // 7 + 1)


CUTOFFS_SQL = """cut AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', min(o_orderdate)) AS TIMESTAMP) + INTERVAL 4 DAY + INTERVAL 21 HOUR,
 CAST(date_trunc('week', max(o_orderdate)) AS TIMESTAMP) + INTERVAL 4 DAY + INTERVAL 21 HOUR, INTERVAL 7 DAY)) AS TIMESTAMP) AS cutoff FROM orders)"""

"""Weekly panels over the driver tables: (series_id, week, price, volume), one row per series and week, missing as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import read_table


def friday(date) -> F.Column:
    """The Friday of the date's week."""
    return F.date_add(F.trunc(date, "week"), 4)


def densify(sparse: DataFrame, keys: list[str], week: str = "week") -> DataFrame:
    """Every key gets a row for every week between the first and the last week of the whole table.

    Two dates come to the driver. Keys are distinct values; the calendar is generated per key, not joined.
    """
    first, last = sparse.agg(F.min(week), F.max(week)).first()
    if first is None:
        return sparse
    weeks = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days"))).alias(week)
    return sparse.select(*keys).distinct().select(*keys, weeks).join(sparse, [*keys, week], "left")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value and count by priority and week."""
    orders = read_table(spark, sf_dir, "orders")
    weekly = orders.groupBy(F.col("o_orderpriority").alias("series_id"), friday(F.col("o_orderdate").cast("date")).alias("week")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("price"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return densify(weekly, ["series_id"])


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by nation and week, with the region as the nation's group."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = (read_table(spark, sf_dir, n) for n in ("nation", "region"))
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("series_id"), F.col("r_name").alias("group_id"))
    weekly = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .groupBy("c_nationkey", friday(F.col("o_orderdate").cast("date")).alias("week"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
        .join(names, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("series_id", "group_id", "week", "price")
    )
    return densify(weekly, ["series_id", "group_id"])


#: DuckDB text of order_panel, as common table expressions.
ORDER_PANEL_SQL = """
wk AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week,
              round(sum(o_totalprice), 2) AS price, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2),
cal AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM wk),
panel AS (SELECT s.series_id, cal.week, wk.price, wk.volume FROM (SELECT DISTINCT series_id FROM wk) s CROSS JOIN cal
          LEFT JOIN wk ON wk.series_id = s.series_id AND wk.week = cal.week)
"""

NATION_PANEL_SQL = """
wk AS (SELECT n_name AS series_id, r_name AS group_id, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, round(sum(o_totalprice), 2) AS price
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
cal AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM wk),
panel AS (SELECT s.series_id, s.group_id, cal.week, wk.price FROM (SELECT DISTINCT series_id, group_id FROM wk) s CROSS JOIN cal
          LEFT JOIN wk ON wk.series_id = s.series_id AND wk.week = cal.week)
"""

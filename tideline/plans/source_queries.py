"""Queries of the payload readers and the snapshot store, on stand-ins made of the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline.plans.registry import register
from tideline.session import checkpoint_root, read_table
from tideline.sources import readers, snapshots
from tideline.sources.observations import OBS_SQL, order_observations


@register(
    "s02_unpivot_vintages",
    """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observed_period_end, CAST(o_orderdate AS DATE) + 3 AS vintage_date,
 round(CASE WHEN count(*) % 4 <> 0 THEN round(max(o_totalprice), 2) END, 2) AS value FROM orders GROUP BY 1, 2, 3""",
    dates=("observed_period_end", "vintage_date"),
)
def s02(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    cells = read_table(spark, sf_dir, "orders").groupBy(day.alias("period"), "o_orderpriority").agg(F.max("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    named = F.concat_ws("_", "o_orderpriority", F.date_format(F.date_add("period", 3), "yyyyMMdd"))
    raw = F.when(F.col("n") % 4 == 0, F.lit(".")).otherwise(F.round("v", 2).cast("decimal(18,2)").cast("string"))
    wide = cells.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct(named.alias("cell"), raw.alias("raw")))).alias("cells"))
    return snapshots.unpivot_vintages(wide)


@register(
    "s06_explode_bars",
    """WITH b AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high, count(*) AS volume FROM orders GROUP BY 1, 2)
SELECT symbol || '.raw_high' AS series_id, week AS observed_period_end, high AS value FROM b UNION ALL SELECT symbol || '.raw_low', week, low FROM b UNION ALL SELECT symbol || '.volume', week, CAST(volume AS DOUBLE) FROM b""",
    dates=("observed_period_end",),
)
def s06(spark, sf_dir):
    week = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "week"), 4)
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    bars = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), week.alias("week")).agg(
        money(F.min("o_totalprice")).alias("low"), money(F.max("o_totalprice")).alias("high"), F.count(F.lit(1)).cast("string").alias("volume")
    )
    fields = F.create_map(F.lit("2. high"), "high", F.lit("3. low"), "low", F.lit("6. volume"), "volume", F.lit("9. unknown"), "volume")
    body = F.to_json(F.create_map(F.lit("Weekly Adjusted Time Series"), F.map_from_entries(F.collect_list(F.struct(F.col("week").cast("string"), fields)))))
    return snapshots.explode_bars(bars.groupBy("symbol").agg(body.alias("body")))


_SNAPS_SQL = """sn AS (SELECT 'orders' AS source, series_id AS dataset, strftime(available_at, '%Y%m') AS snapshot_id, max(available_at) AS retrieved_at,
 CAST(date_trunc('month', min(available_at)) + INTERVAL 15 DAY AS DATE) AS cutoff FROM obs GROUP BY 1, 2, 3),
snaps AS (SELECT *, CASE WHEN CAST(snapshot_id AS INT) % 5 = 0 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN CAST(snapshot_id AS INT) % 6 = 1 THEN 'full' ELSE 'delta' END AS mode FROM sn)"""


def _stores(spark, sf_dir):
    rows = order_observations(spark, sf_dir).withColumn("dataset", F.col("series_id")).withColumn("snapshot_id", F.date_format("available_at", "yyyyMM"))
    number = F.col("snapshot_id").cast("int")
    taken = rows.groupBy("source", "dataset", "snapshot_id").agg(F.max("available_at").alias("retrieved_at"), F.date_add(F.trunc(F.min("available_at").cast("date"), "month"), 15).alias("cutoff"))
    return rows, taken.withColumns({"status": F.when(number % 5 == 0, "degraded").otherwise("ok"), "mode": F.when(number % 6 == 1, "full").otherwise("delta")})


@register(
    "s09_last_good",
    f"""WITH {OBS_SQL}, {_SNAPS_SQL}, good AS (SELECT * FROM snaps WHERE status = 'ok'), fulls AS (SELECT dataset, max(snapshot_id) AS since FROM good WHERE mode = 'full' GROUP BY 1),
vis AS (SELECT good.* FROM good JOIN fulls USING (dataset) WHERE snapshot_id >= since),
eff AS (SELECT o.* FROM obs o JOIN vis v ON o.series_id = v.dataset AND strftime(o.available_at, '%Y%m') = v.snapshot_id WHERE o.observed_period_end <= v.cutoff
 QUALIFY row_number() OVER (PARTITION BY o.source, o.series_id, o.observed_period_end, o.vintage_date, o.available_at ORDER BY v.snapshot_id DESC, o.retrieved_at DESC, o.revision_seq DESC, o.raw_sha256 DESC) = 1)
SELECT series_id, observed_period_end, available_at, value, raw_sha256, row_number() OVER (PARTITION BY source, series_id, observed_period_end ORDER BY available_at, vintage_date, raw_sha256, value NULLS FIRST, retrieved_at) - 1 AS revision_seq FROM eff""",
    dates=("observed_period_end", "available_at"),
)
def s09(spark, sf_dir):
    rows, taken = _stores(spark, sf_dir)
    found = snapshots.last_good(taken, rows)
    return found.select("series_id", "observed_period_end", "available_at", "value", "raw_sha256", F.col("revision_seq").cast("long"))


@register(
    "s10_latest_snapshot",
    f"WITH {OBS_SQL}, {_SNAPS_SQL} SELECT dataset, snapshot_id, mode, cutoff FROM snaps WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY retrieved_at DESC, snapshot_id DESC) = 1",
    dates=("cutoff",),
)
def s10(spark, sf_dir):
    return snapshots.latest_ok(_stores(spark, sf_dir)[1]).select("dataset", "snapshot_id", "mode", "cutoff")


@register(
    "k01_append_snapshot",
    """SELECT o_orderstatus AS snapshot_id, o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observed_period_end, round(sum(o_totalprice), 2) AS value
 FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""",
    dates=("observed_period_end",),
)
def k01(spark, sf_dir):
    """A snapshot for each order status; that of P is staged only, as if its job had died before the commit row."""
    root = f"{checkpoint_root(spark)}/tideline/store-{uuid.uuid4().hex}"
    day = F.col("o_orderdate").cast("date")
    rows = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("series_id"), day.alias("observed_period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    for status in ("F", "O", "P"):
        own = rows.filter(F.col("o_orderstatus") == status).drop("o_orderstatus")
        if status == "P":
            snapshots.stage_rows(own, root, status)
        else:
            snapshots.append_snapshot(own, root, status, {"source": "orders", "token": status})
    return snapshots.committed(spark, root, "series_id string, observed_period_end date, value double")[1]


VINTAGES = [f"{y}-12-31" for y in range(1995, 2002)]


@register(
    "s03_full_vintages",
    f"""WITH o AS (SELECT o_orderpriority AS s, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, l_extendedprice AS v, l_shipdate AS sh FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT s, week, vd, round(sum(v) FILTER (sh < vd + 1), 2) AS v FROM o, (SELECT unnest([{', '.join(f"DATE '{v}'" for v in VINTAGES)}]) AS vd) GROUP BY 1, 2, 3),
m AS (SELECT s, CAST(date_trunc('month', week) AS DATE) AS month, vd, sum(v) AS v FROM c GROUP BY 1, 2, 3),
k AS (SELECT *, lag(v) OVER (PARTITION BY s, month ORDER BY vd) AS before FROM m)
SELECT s AS series_id, month AS observed_period_end, vd AS vintage_date, round(v, 2) AS value, row_number() OVER (PARTITION BY s, month ORDER BY vd) - 1 AS revision_seq FROM k WHERE round(v, 4) IS DISTINCT FROM round(before, 4)""",
    dates=("observed_period_end", "vintage_date"),
)
def s03(spark, sf_dir):
    """Whole vintages, one a year: the weekly order value shipped by then, aggregated to months inside a vintage."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"), F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "week"), 4).alias("period"))
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("shipped")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = rows.groupBy("series_id", "period").agg(*[F.round(F.sum(F.when(F.col("shipped") <= F.lit(v).cast("date"), F.col("l_extendedprice"))), 2).cast("decimal(18,2)").cast("string").alias(v) for v in VINTAGES])
    cells = [x for v in VINTAGES for x in (F.concat_ws("_", "series_id", F.lit(v.replace("-", ""))), F.coalesce(F.col(v), F.lit(".")))]
    good, rejected = readers.full_vintages(sums.select("series_id", "period", F.create_map(*cells).alias("cells")), VINTAGES, frequency="month", method="sum")
    return good.withColumns({"value": F.round("value", 2), "revision_seq": F.col("revision_seq").cast("long")})


@register(
    "s11_strict_json",
    "WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(round(value * 100) AS BIGINT) NOT BETWEEN -32768 AND 32767 AS rejected FROM events) SELECT event_id, CASE WHEN NOT rejected THEN k END AS k, rejected FROM e",
    dates=(),
)
def s11_json(spark, sf_dir):
    """Events as JSON lines, read with cents of two bytes: rows that do not fit are kept as text."""
    folder = f"{checkpoint_root(spark)}/tideline/json-{uuid.uuid4().hex}"
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    read_table(spark, sf_dir, "events").select("event_id", cents, "event_type", F.from_json("props", "k int").alias("props")).write.json(folder)
    good, bad = readers.read_json(spark, folder, "event_id long, cents smallint, event_type string, props struct<k:int>", required=["event_id"])
    lost = bad.select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.lit(None).cast("int").alias("k"), F.lit(True).alias("rejected"))
    return good.select("event_id", "props.k", F.lit(False).alias("rejected")).unionByName(lost)


@register("s11_strict_csv", "SELECT o_orderkey, CASE WHEN o_custkey <= 127 THEN round(o_totalprice, 2) END AS price, o_custkey > 127 AS rejected FROM orders", dates=())
def s11_csv(spark, sf_dir):
    """Orders as CSV with a header, read with a customer key of one byte."""
    folder = f"{checkpoint_root(spark)}/tideline/csv-{uuid.uuid4().hex}"
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), "o_orderpriority")
    orders.write.option("header", "true").csv(folder)
    good, bad = readers.read_csv(spark, folder, "o_orderkey long, o_custkey tinyint, price double, o_orderpriority string", required=["o_orderkey"])
    lost = bad.select(F.split("record", ",")[0].cast("long").alias("o_orderkey"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("rejected"))
    return good.select("o_orderkey", "price", F.lit(False).alias("rejected")).unionByName(lost)

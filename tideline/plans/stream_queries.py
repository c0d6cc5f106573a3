"""Streaming forms over the driver tables, run over what is there now, with DuckDB SQL of the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.plans.forecast_queries import BASE, RUNS, _fitted, labelled
from tideline.plans.registry import register
from tideline.session import checkpoint_root, materialize, read_table
from tideline.streaming import weekly


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/tideline/stream-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    """The events as a stream of files; they have no zone, and are read as UTC."""
    folder = f"{_folder(spark)}/events"
    read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(folder)
    return weekly.stream_table(spark, folder, files_at_once=1000)


@register(
    "st01_weekly_windows",
    "SELECT event_type, CAST(date_trunc('week', ts - INTERVAL 5 DAY) AS DATE) + 12 AS week_end, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1, 2",
    dates=("week_end",),
)
def st01(spark, sf_dir):
    folder = _folder(spark)
    totals = weekly.counted(weekly.weekly_totals(_events(spark, sf_dir), "ts", "event_type", "value"), f"{folder}/out", f"{folder}/state")
    return rounded(totals.withColumn("week_end", F.col("week_end").cast("date")))


@register(
    "st02_rolling_day",
    """SELECT event_type, CAST(u AS VARCHAR) AS until, count(*) AS n FROM (
 SELECT event_type, to_timestamp((CAST(floor(epoch(ts) / 21600) AS BIGINT) + k) * 21600) AT TIME ZONE 'UTC' AS u FROM events, (VALUES (1), (2), (3), (4)) v(k)) GROUP BY 1, 2""",
    dates=(),
)
def st02(spark, sf_dir):
    folder = _folder(spark)
    return weekly.counted(weekly.rolling_day(_events(spark, sf_dir), "ts", "event_type"), f"{folder}/out", f"{folder}/state")


@register("st03_dedup_within_watermark", "SELECT DISTINCT event_id FROM events", dates=())
def st03(spark, sf_dir):
    """Every event is sent twice; the watermark is far behind, as the file is in no order."""
    folder = _folder(spark)
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return weekly.written(weekly.once(twice, ["event_id"], "ts", "3650 days").select("event_id"), f"{folder}/out", f"{folder}/state")


@register(
    "st04_prospective_revisions",
    """WITH o AS (SELECT user_id, value, ts, row_number() OVER w AS i, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
c AS (SELECT * FROM o WHERE i = 1 OR value IS DISTINCT FROM before)
SELECT user_id, round(value, 6) + 0.0 AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS available_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS INT) AS revision_seq FROM c""",
    dates=(),
)
def st04(spark, sf_dir):
    """The readings of each user as revisions of one value, available from their arrival on."""
    folder = _folder(spark)
    arrivals = _events(spark, sf_dir).select("user_id", "value", F.col("ts").alias("arrived"))
    found = weekly.collect_revisions(arrivals, ["user_id"], "value", "arrived", f"{folder}/out", f"{folder}/state")
    return rounded(found).withColumn("available_at", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"))


@register("st05_label_machine", BASE + " SELECT series_id, week, state FROM lab")
def st05(spark, sf_dir):
    """The state machine over a stream of scores; its SQL is that of the batch labels."""
    folder = _folder(spark)
    _fitted(spark, sf_dir).select("series_id", "week", "risk_score", "lower", "upper").write.parquet(f"{folder}/scores")
    stream = weekly.stream_table(spark, f"{folder}/scores", files_at_once=1000)
    return materialize(weekly.written(weekly.label_machine(stream), f"{folder}/out", f"{folder}/state"), "stream-labels")


@register(
    "st06_run_lengths",
    BASE + RUNS + " SELECT series_id, week, state, duration FROM dur",
)
def st06(spark, sf_dir):
    """Run lengths with expiry over a stream of labels; weekly labels have no silence."""
    folder = _folder(spark)
    labels = labelled(spark, sf_dir).select("series_id", F.to_timestamp("week").alias("ts"), "state")
    labels.write.parquet(f"{folder}/labels")
    stream = weekly.stream_table(spark, f"{folder}/labels", files_at_once=1000)
    return materialize(weekly.written(weekly.run_lengths(stream), f"{folder}/out", f"{folder}/state"), "stream-runs")


@register(
    "st07_net_weeks",
    """WITH r AS (SELECT user_id, event_type, CAST(date_trunc('week', ts) AS DATE) AS week, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT event_type, week, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM r WHERE k = 1 AND event_type <> 'signup' GROUP BY 1, 2""",
)
def st07(spark, sf_dir):
    """Every event is a revision of its user's row, a signup withdraws it: weekly totals of the rows that stand."""
    folder = _folder(spark)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read_table(spark, sf_dir, "events").withColumns({"week": F.trunc(F.col("ts").cast("date"), "week"), "seq": F.row_number().over(order)})
    stated = events.select("user_id", "event_type", "week", F.when(F.col("event_type") != "signup", F.col("value")).alias("value"), "seq")
    stated.write.parquet(f"{folder}/events")
    stream = weekly.stream_table(spark, f"{folder}/events", files_at_once=1000)
    return rounded(weekly.net_weeks(stream, "user_id", "event_type", "week", "value", "seq", f"{folder}/out", f"{folder}/state"))

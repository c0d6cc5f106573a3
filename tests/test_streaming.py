"""Streams over two batches of files against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import labels
from tideline.streaming import weekly


def write(spark, rows, schema, path, k):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folders(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"


AT = dt.datetime(2024, 1, 4, 12, tzinfo=dt.UTC)
EVENTS = "id long, kind string, ts timestamp, value double"


def hours(n):
    return AT + dt.timedelta(hours=n)


def test_weeks_over_two_batches(spark, folders):
    src, out, state = folders
    first = [(1, "a", hours(0), 1.0), (2, "a", hours(11.5), 2.0), (3, "a", hours(12), 4.0), (4, None, hours(13), 1.0), (5, "a", None, 9.0)]
    write(spark, first, EVENTS, src, 0)
    stream = lambda: weekly.stream_table(spark, src)
    totals = lambda df: sorted(tuple(r) for r in weekly.weekly_totals(df, "ts", "kind", "value").collect() if r[0])
    weekly.counted(weekly.weekly_totals(stream(), "ts", "kind", "value"), out, state)
    write(spark, [(6, "a", hours(14), 8.0), (8, "a", hours(36), 16.0), (7, "b", hours(400), 1.0)], EVENTS, src, 1)
    got = weekly.counted(weekly.weekly_totals(stream(), "ts", "kind", "value"), out, state)
    want = totals(spark.read.parquet(src))
    assert sorted(tuple(r) for r in got.collect() if r[0]) == want
    # Friday is the last day of a week
    assert [(r[1].date(), r[3]) for r in want if r[0] == "a"] == [(dt.date(2024, 1, 6), 15.0), (dt.date(2024, 1, 13), 16.0)]


def test_replays_are_dropped(spark, folders):
    src, out, state = folders
    write(spark, [(1, "a", hours(0), 1.0), (1, "a", hours(0), 1.0), (2, "a", hours(1), 1.0)], EVENTS, src, 0)
    one = lambda: weekly.written(weekly.once(weekly.stream_table(spark, src), ["id"], "ts", "2 days"), out, state)
    assert sorted(r.id for r in one().collect()) == [1, 2]
    write(spark, [(2, "a", hours(1), 1.0), (3, "a", hours(2), 1.0), (1, "a", hours(0), 1.0)], EVENTS, src, 1)
    assert sorted(r.id for r in one().collect()) == [1, 2, 3]


def test_late_and_changed_rows_become_revisions(spark, folders):
    src, out, state = folders
    schema = "period int, value double, arrived timestamp"
    collect = lambda: weekly.collect_revisions(weekly.stream_table(spark, src), ["period"], "value", "arrived", out, state)
    write(spark, [(1, 10.0, hours(0)), (2, 20.0, hours(0)), (3, 30.0, hours(0))], schema, src, 0)
    assert collect().count() == 3
    # 1 changes, 2 is replayed, 3 is not named (no delete), 0 is late, 4 is a tombstone
    write(spark, [(1, 11.0, hours(5)), (2, 20.0, hours(5)), (0, 5.0, hours(5)), (4, None, hours(5))], schema, src, 1)
    rows = sorted((r.period, r.revision_seq, r.value, r.available_at.hour) for r in collect().collect())
    late = hours(5).hour if spark.conf.get("spark.sql.session.timeZone") == "UTC" else rows[0][3]
    assert [r[:3] for r in rows] == [(0, 0, 5.0), (1, 0, 10.0), (1, 1, 11.0), (2, 0, 20.0), (3, 0, 30.0), (4, 0, None)]
    assert rows[0][3] == rows[2][3] and rows[1][3] != late
    newest = {r.period: r.value for r in weekly.latest(collect(), ["period"]).collect()}
    assert newest == {0: 5.0, 1: 11.0, 2: 20.0, 3: 30.0, 4: None}


def test_state_machine_over_two_batches(spark, folders):
    src, out, state = folders
    scores = [0.0, 1.2, 0.95, 0.8, None, -1.3, -0.9, 0.1, 2.0, -2.0, 0.0, 0.4]
    rows = [(s, dt.date(2024, 1, 5) + dt.timedelta(7 * k), v if s == "a" else (None if v is None else -v), -1.0, 1.0) for s in "ab" for k, v in enumerate(scores)]
    schema = "series_id string, week date, risk_score double, lower double, upper double"
    cut = dt.date(2024, 2, 9)
    write(spark, [r for r in rows if r[1] <= cut], schema, src, 0)
    run = lambda: weekly.written(weekly.label_machine(weekly.stream_table(spark, src)), out, state)
    assert run().count() == 12
    late = [("a", dt.date(2023, 12, 29), 5.0, -1.0, 1.0)]
    write(spark, [r for r in rows if r[1] > cut] + late, schema, src, 1)
    want = {(r.series_id, r.week): r.state for r in labels.label(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.series_id, r.week): r.state for r in run().collect()} == want


def test_open_weeks_stay_out(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5), dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 12), dt.date(2024, 1, 8)), (3, None, dt.date(2024, 1, 8))], "k int, week date, cutoff date")
    assert [r.k for r in weekly.closed_weeks(rows, "week", "cutoff").collect()] == [1]
    assert weekly.closed_weeks(rows.limit(0), "week", "cutoff").count() == 0
    assert rows.select(F.max("k")).first()[0] == 3

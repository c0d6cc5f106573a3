"""Revisions by hand: zones, statuses, prepared snapshots and windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import cross_section, pit

ZONES = ["UTC", "Asia/Tokyo", "America/New_York"]


@pytest.fixture(params=ZONES)
def zoned(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_a_friday_release_misses_the_friday_cutoff_in_any_zone(zoned):
    rows = zoned.sql("SELECT DATE'2024-01-05' AS d UNION ALL SELECT DATE'2024-07-05'").withColumn("at", pit.date_available(F.col("d")))
    calendar = pit.WeeklyCalendar(dt.datetime(2024, 1, 5, 21), 40)
    found = rows.select("d", F.unix_seconds("at").alias("s"), calendar.first_index(F.col("at"), F.col("d")).alias("k")).orderBy("d").collect()
    want = [dt.datetime(2024, 1, 5, 23, tzinfo=dt.UTC), dt.datetime(2024, 7, 5, 22, tzinfo=dt.UTC)]
    assert [r.s for r in found] == [int(w.timestamp()) for w in want]
    assert [r.k for r in found] == [1, 27]


def test_zoneless_times_are_utc_in_any_zone(zoned):
    rows = zoned.sql("SELECT timestamp_ntz'2024-01-05 20:30:00' AS at, DATE'2024-01-05' AS p UNION ALL SELECT timestamp_ntz'2024-01-05 21:00:01.5', DATE'2024-01-05'")
    calendar = pit.WeeklyCalendar(dt.datetime(2024, 1, 5, 21), 4)
    assert sorted(r.k for r in rows.select(calendar.first_index(F.col("at"), F.col("p")).alias("k")).collect()) == [0, 1]
    obs = rows.select(
        F.lit("s").alias("source"), F.lit("a").alias("series_id"), F.col("p").alias("observed_period_end"), F.second("at").cast("double").alias("value"),
        F.col("at").alias("available_at"), F.col("p").alias("vintage_date"), F.second("at").alias("revision_seq"), F.col("at").alias("retrieved_at"), F.lit("x").alias("raw_sha256"),
    )
    panel = pit.asof_panel(obs, obs.select("source", "series_id").distinct(), calendar, 10)
    got = panel.select(F.unix_seconds("cutoff").alias("c"), "value", "release_lag_days", "age_days", "is_filled").orderBy("c").collect()
    assert [(r.value, r.release_lag_days, r.age_days, r.is_filled) for r in got] == [(0.0, 0, 0, False), (1.0, 0, 7, True), (1.0, 0, 14, True), (1.0, 0, 21, True)]
    assert pit.source_rows(obs, dt.datetime(2024, 1, 5, 21)).first()["n_usable"] == 1


def test_nine_statuses_and_an_unknown_one(spark):
    order = ["ok", "stale", "unavailable", "degraded", "revision_gap", "quota_exhausted", "rights_unconfirmed", "schema_changed", "license_blocked", "no_such_status"]
    rows = [(f"{a}|{b}", s) for i, a in enumerate(order) for b in order[i:] for s in (a, b)]
    frame = spark.createDataFrame([*rows, ("none", None)], "key string, status string")
    got = {r.key: r.status for r in pit.combine_health(frame, ["key"]).collect()}
    assert got == {k: k.split("|")[1] for k, _ in rows} | {"none": "ok"}
    worst = {r.key: r.status for r in cross_section.worst_health(frame, order[:9]).collect()}
    assert worst == {k: k.split("|")[1] for k, _ in rows}
    results = spark.createDataFrame([("a", "ok", 3, "x"), ("a", "rights_unconfirmed", 5, "y"), ("a", "ok", 4, "x"), ("b", "mystery", 9, None)], "source string, status string, records int, issue string")
    merged = {r.source: (r.status, r.records, r.issues) for r in pit.merge_results(results).collect()}
    assert merged == {"a": ("rights_unconfirmed", 7, "x; y"), "b": ("mystery", 0, "")}
    assert pit.combine_health(frame.limit(0), ["key"]).count() == 0


DAY = lambda n: dt.date(2024, 1, n)
AT = lambda n: dt.datetime(2024, 2, n, tzinfo=dt.UTC)


def prepared(spark, old, new):
    key, schema = ["s", "p"], "s string, p date, value double"
    a = spark.createDataFrame(old, f"{schema}, available_at timestamp")
    b = spark.createDataFrame(new, f"{schema}, retrieved_at timestamp")
    return pit.snapshot_diff(a.drop("available_at"), b.drop("retrieved_at"), key, ["value"]).join(a.drop("value"), key, "left").join(b.drop("value"), key, "left")


def test_prepared_snapshots(spark):
    old = [(s, DAY(k), 1.0, AT(5)) for s in "abcd" for k in (5, 12)]
    new = [("a", DAY(5), 2.0, AT(6)), ("a", DAY(12), 1.0, AT(6)), ("a", DAY(19), 3.0, AT(6)), ("a", DAY(9), 4.0, AT(6))]
    new += [("b", DAY(5), 1.0, AT(6)), ("b", DAY(19), 1.0, AT(6))]  # a period vanished
    new += [("c", DAY(5), 9.0, AT(5)), ("c", DAY(12), 1.0, AT(5))]  # found no later than known
    new += [("d", DAY(5), None, AT(6)), ("d", DAY(12), 1.0, AT(6)), ("e", DAY(5), 1.0, AT(6))]
    diff = prepared(spark, old, new)
    modes = {r.s: (r.mode, r.status, r.n_stored) for r in pit.snapshot_mode(diff, ["s"], "available_at", "retrieved_at").collect()}
    assert modes == {"a": ("delta", "ok", 3), "b": ("delta", "degraded", 0), "c": ("delta", "degraded", 0), "d": ("delta", "ok", 1), "e": ("full", "ok", 1)}
    rows = pit.prospective_revisions(diff, ["s"], "p", "p", "retrieved_at").filter("s = 'a'").orderBy("p").collect()
    assert [(r.p.day, r.reason, r.available_at.astimezone(dt.UTC).month, r.reported_available_at is None) for r in rows] == [
        (5, "provider_value_changed", 2, False), (9, "historical_backfill", 2, False), (19, None, 1, True),
    ]


def test_windows(spark):
    obs = spark.createDataFrame([("a", DAY(10)), ("a", DAY(8)), ("b", DAY(2)), ("c", None)], "series_id string, vintage_date date")
    plan = lambda days: {r.series_id: (r.window_start.day, r.mode) for r in pit.plan_windows(obs, DAY(1), DAY(20), ["series_id"], days).collect()}
    assert plan(1) == {"a": (10, "delta"), "b": (2, "delta"), "c": (1, "full")}
    assert plan(3) == {"a": (8, "delta"), "b": (1, "delta"), "c": (1, "full")}
    with pytest.raises(Exception, match="before the last successful"):
        pit.plan_windows(obs, DAY(1), DAY(9), ["series_id"]).collect()


def test_expansion(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "q"), ("c", "x"), ("c", "y"), ("c", "z"), ("d", "z"), ("d", "z")]
    frame = spark.createDataFrame(rows, "k string, series_id string")
    got = sorted(tuple(r) for r in pit.expansion(frame, ["x", "y", "z"], ["k"]).collect())
    assert got == [("a", "z"), ("d", "x"), ("d", "y")]  # b holds a strange one, c is complete
    assert pit.expansion(frame.limit(0), ["x"], ["k"]).count() == 0


def test_revisions_are_deduplicated_and_numbered_in_one_shuffle(spark):
    draw = random.Random(5)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rows = [
        (draw.choice("ab"), draw.choice("st"), dt.date(2024, 1, draw.choice((1, 2))), draw.choice((None, -1.0, 2.0)), draw.choice((None, at(1), at(2))), draw.choice((None, dt.date(2024, 1, 3))),
         draw.choice((None, at(3), at(4))), draw.choice((None, 0, 1)), draw.choice((None, "00ab", "00aB", "00a", "0f", "x")))
        for _ in range(600)
    ]
    names = ["source", "series_id", "observed_period_end", "value", "available_at", "vintage_date", "retrieved_at", "revision_seq", "raw_sha256"]
    obs = spark.createDataFrame(rows, "source string, series_id string, observed_period_end date, value double, available_at timestamp_ntz, vintage_date date, retrieved_at timestamp_ntz, revision_seq int, raw_sha256 string")
    up = lambda *xs: tuple((x is not None, x) if x is not None else (False,) for x in xs)
    best, want = {}, set()
    for r in rows:
        key, rank = (*r[:3], r[4], r[5], r[8]), up(r[6], r[7], r[3])
        if key not in best or rank > best[key][0]:
            best[key] = rank, r
    for period in {k[:3] for k in best}:
        own = sorted((k for k in best if k[:3] == period), key=lambda k: up(*k[3:]))
        want |= {(*best[k][1][:7], n, k[5]) for n, k in enumerate(own)}
    found = pit.sequence_revisions(obs)
    assert found.columns == names and len(want) < 600
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1

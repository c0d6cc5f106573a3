"""Generations that die half-way, runs with expiry, and withdrawals from published weeks."""

import datetime as dt

import pytest

from tideline.operators import features
from tideline.streaming import weekly
from tideline.streaming.generations import Generations


@pytest.fixture
def folders(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def values(df):
    return sorted(r[0] for r in df.collect())


def test_a_generation_is_whole_or_not_there(spark, folders):
    store = Generations(spark, folders[1], "v int", keep=2)
    more = lambda *v: lambda known: known.unionByName(spark.createDataFrame([(x,) for x in v], "v int"))
    assert values(store.current()) == [] and store.number() is None
    assert store.publish(0, more(1, 2))
    reader = store.current()

    def dies(known):  # half of the rows are written when a task fails
        return spark.sql("SELECT CAST(id AS INT) AS v FROM range(0, 1000, 1, 4)").selectExpr("CASE WHEN v = 900 THEN raise_error('lost') ELSE v END AS v")

    with pytest.raises(Exception, match="lost"):
        store.publish(1, dies)
    assert values(store.current()) == [1, 2] and store.number() == 0
    assert store.publish(1, more(3))
    assert not store.publish(1, more(4))  # retried after its pointer was set
    assert values(store.current()) == [1, 2, 3] and values(store.current(before=1)) == [1, 2]
    assert values(reader) == [1, 2]  # a reader that began earlier still sees its generation
    assert store.publish(2, more()) and sorted(store._pointers()) == [1, 2]


def test_a_killed_batch_is_published_once(spark, folders):
    src, out, state = folders
    schema = "kind string, ts timestamp, value double"
    at = lambda h: dt.datetime(2024, 1, 4, h, tzinfo=dt.UTC)
    write(spark, [("a", at(1), 1.0), ("a", at(2), 2.0)], schema, src)
    totals = lambda: weekly.weekly_totals(weekly.stream_table(spark, src), "ts", "kind", "value")
    store = Generations(spark, out, "kind string, week_end timestamp, n long, total double")
    weekly.counted(totals(), out, state)

    def killed(batch, number):  # dies after the pointer, before the query commits its batch
        store.publish(number, lambda _: batch)
        raise RuntimeError("killed")

    write(spark, [("a", at(3), 4.0)], schema, src)
    with pytest.raises(Exception, match="killed"):
        weekly.run_now(totals(), killed, state, mode="complete")
    assert [(r.n, r.total) for r in store.current().collect()] == [(3, 7.0)]
    assert [(r.n, r.total) for r in weekly.counted(totals(), out, state).collect()] == [(3, 7.0)]
    assert store.number() == 1


FRIDAY = dt.datetime(2024, 1, 5, 21, tzinfo=dt.UTC)


def test_run_lengths_over_many_batches(spark, folders):
    src, out, state = folders
    labels = ["on", "on", "off", "off", "off", "on", "mid", "mid", "mid", "mid"]
    rows = [(s, FRIDAY + dt.timedelta(7 * k), labels[(k + shift) % 10]) for s, shift in (("a", 0), ("b", 3)) for k in range(10)]
    schema = "series_id string, ts timestamp, state string"
    run = lambda: weekly.written(weekly.run_lengths(weekly.stream_table(spark, src)), out, state)
    for cut in ((0, 3), (3, 4), (4, 8), (8, 10)):
        write(spark, [r for k, r in enumerate(rows) if cut[0] <= k % 10 < cut[1]], schema, src)
        got = run()
    weeks = spark.createDataFrame([(s, ts.date(), x) for s, ts, x in rows], "series_id string, week date, state string")
    want = {(r.series_id, r.week): r.duration for r in features.state_durations(weeks).collect()}
    assert {(r.series_id, r.week): r.duration for r in got.collect()} == want


def test_a_run_ends_with_silence(spark, folders):
    src, out, state = folders
    schema = "series_id string, ts timestamp, state string"
    week = lambda k: FRIDAY + dt.timedelta(7 * k)
    run = lambda: {(r.series_id, r.week): r.duration for r in weekly.written(weekly.run_lengths(weekly.stream_table(spark, src)), out, state).collect()}
    write(spark, [("a", week(0), "on"), ("a", week(1), "on"), ("b", week(1), "on")], schema, src)
    run()
    write(spark, [("b", week(k), "on") for k in range(2, 9)], schema, src)  # a is silent for long
    run()
    write(spark, [("b", week(9), "on")], schema, src)  # the watermark has passed a's timeout
    run()
    kept = spark.read.format("statestore").load(state).select("key.series_id").collect() if _has_state_reader(spark, state) else None
    assert kept is None or {r.series_id for r in kept} == {"b"}
    # one week of a is not after the watermark, and late
    write(spark, [("a", week(11), "on"), ("b", week(10), "on"), ("a", week(10), "on"), ("a", week(9), "on")], schema, src)
    got = run()
    assert got["a", week(10).date()] == 1 and got["a", week(11).date()] == 2 and got["b", week(10).date()] == 10
    assert got["a", week(1).date()] == 2 and ("a", week(9).date()) not in got


def _has_state_reader(spark, state):
    try:
        spark.read.format("statestore").load(state).schema
        return True
    except Exception:
        return False


def test_withdrawals_leave_published_weeks(spark, folders):
    src, out, state = folders
    schema = "id long, kind string, day date, value double, seq int"
    day = lambda n: dt.date(2024, 1, n)
    net = lambda: {(r.kind, r.week): (r.n, r.total) for r in weekly.net_weeks(weekly.stream_table(spark, src), "id", "kind", "day", "value", "seq", out, state).collect()}
    write(spark, [(1, "a", day(5), 1.0, 0), (2, "a", day(5), 2.0, 0), (3, "a", day(12), 4.0, 0), (4, "b", day(5), 8.0, 0), (None, "b", day(5), 8.0, 0)], schema, src)
    assert net() == {("a", day(5)): (2, 3.0), ("a", day(12)): (1, 4.0), ("b", day(5)): (1, 8.0)}
    # 1 is withdrawn, 2 changes, 3 moves to another week, 4 is withdrawn and its week is empty
    write(spark, [(1, "a", day(5), None, 1), (2, "a", day(5), 2.5, 1), (3, "a", day(19), 4.0, 1), (4, "b", day(5), None, 1)], schema, src)
    assert net() == {("a", day(5)): (1, 2.5), ("a", day(19)): (1, 4.0)}
    # a replay and a late revision do nothing; 1 comes back
    write(spark, [(2, "a", day(5), 2.5, 1), (3, "a", day(12), 9.0, 0), (1, "a", day(5), 1.5, 2)], schema, src)
    assert net() == {("a", day(5)): (2, 4.0), ("a", day(19)): (1, 4.0)}
    newest = weekly.latest(spark.read.parquet(src).filter("id IS NOT NULL").withColumnRenamed("seq", "revision_seq"), ["id"]).filter("value IS NOT NULL")
    batch = {(r.kind, r.day): (r.n, r.total) for r in newest.groupBy("kind", "day").agg({"*": "count", "value": "sum"}).toDF("kind", "day", "n", "total").collect()}
    assert net() == batch

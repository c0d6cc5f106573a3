"""The gates and the redaction against hand-written cases."""

import datetime as dt

from pyspark.sql import functions as F

from tideline.operators import gates

FRIDAY = dt.date(2024, 3, 29)  # Good Friday
OBS = "symbol string, field string, period date, value double, available_day date, status string"


def weeks(n, last=FRIDAY):
    return [last - dt.timedelta(7 * k) for k in range(n)]


def test_baseline_series_by_hand(spark):
    rows = [("A", f, d, 1.0, d, "ok") for f in ("close", "open") for d in weeks(10)]
    rows += [("B", f, d, 1.0, d, "ok") for f in ("close", "open") for d in weeks(10 if f == "close" else 9)]
    rows += [("C", "close", d, 1.0, d, "ok") for d in weeks(4)] + [("C", "close", FRIDAY, 2.0, FRIDAY, "ok")]
    rows += [("D", "close", d, 1.0, d, "ok") for d in weeks(10)[3:]]
    rows += [("E", "close", d, None if k == 1 else 1.0, d + dt.timedelta(k == 0), "stale" if k == 2 else "ok") for k, d in enumerate(weeks(12))]
    rows += [("Z", "close", FRIDAY, 1.0, FRIDAY, "ok")]
    expected = [(s, f, None) for s in "AB" for f in ("close", "open")] + [("C", "close", FRIDAY - dt.timedelta(21)), ("D", "close", None), ("E", "close", None), ("F", "close", None)]
    series = gates.baseline_series(spark.createDataFrame(rows, OBS), spark.createDataFrame(expected, "symbol string, field string, inception date"), str(FRIDAY - dt.timedelta(63)), str(FRIDAY))
    got = {(r.symbol, r.field): r for r in series.collect()}
    assert {k: r.reasons for k, r in got.items()} == {
        ("A", "close"): [], ("A", "open"): [], ("B", "close"): ["fields_differ"], ("B", "open"): ["fields_differ"], ("C", "close"): ["repeated"],
        ("D", "close"): ["insufficient", "stale"], ("E", "close"): ["insufficient", "stale", "invalid"], ("F", "close"): ["missing", "insufficient", "stale"], ("Z", "close"): ["unexpected"],
    }
    assert got["C", "close"].expected_periods == got["C", "close"].periods == 4 and got["A", "open"].expected_periods == 10
    assert got["E", "close"].n_invalid == 5 and got["Z", "close"].expected_periods is None
    gate = gates.baseline_gate(series).first()
    assert (gate.n_series, gate.n_stale, gate.n_unexpected, gate.passed) == (9, 3, 1, False)
    assert gates.baseline_gate(series.filter("symbol = 'A'")).first().passed
    assert not gates.baseline_gate(series.limit(0)).first().passed


def utc(day, hour=20, minute=0):
    return dt.datetime(day.year, day.month, day.day, hour, minute)


def test_market_weeks(spark):
    thursday, cutoff = FRIDAY - dt.timedelta(1), utc(FRIDAY)  # 16:00 in New York in summer time
    cases = [
        (FRIDAY, utc(FRIDAY), cutoff, True), (thursday, utc(thursday), cutoff, True), (FRIDAY - dt.timedelta(7), utc(FRIDAY - dt.timedelta(7)), cutoff, False),
        (FRIDAY - dt.timedelta(5), utc(FRIDAY - dt.timedelta(5)), cutoff, False), (thursday, utc(FRIDAY), cutoff, False), (FRIDAY, utc(FRIDAY, 19), cutoff, False),
        (thursday, utc(thursday, 20, 1), cutoff, False), (None, utc(FRIDAY), cutoff, False), (FRIDAY, None, cutoff, False), (FRIDAY, utc(FRIDAY), None, False),
        (dt.date(2024, 3, 8), utc(dt.date(2024, 3, 8), 21), utc(dt.date(2024, 3, 8), 21), True),  # winter time
    ]
    rows = [(k, *c) for k, c in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, coverage_end date, available_at timestamp_ntz, cutoff timestamp_ntz, want boolean")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = frame.withColumn("got", gates.in_market_week(F.col("coverage_end"), F.col("available_at"), F.col("cutoff"))).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.k for r in found if r.got != r.want] == []


def test_collections(spark):
    cutoff, rows = utc(FRIDAY), []

    def add(name, *sources):
        for source, status, issues, day, at in sources:
            rows.append((name, at, source, status, issues, day, utc(day)))

    good = [("market", "ok", [], FRIDAY, cutoff), ("macro", "ok", None, FRIDAY - dt.timedelta(90), cutoff)]
    add("good", *good)
    add("alone", good[0])
    add("twice", good[0], good[0], good[1])
    add("strange", *good, ("other", "ok", [], FRIDAY, cutoff))
    add("ill", good[0], ("macro", "stale", [], FRIDAY, cutoff))
    add("unknown", good[0], ("macro", None, [], FRIDAY, cutoff))
    add("noted", good[0], ("macro", "ok", ["late"], FRIDAY, cutoff))
    add("old", ("market", "ok", [], FRIDAY - dt.timedelta(7), cutoff), good[1])
    add("cutoffs", good[0], ("macro", "ok", [], FRIDAY, cutoff - dt.timedelta(7)))
    frame = spark.createDataFrame(rows, "name string, cutoff timestamp_ntz, source string, status string, issues array<string>, coverage_end date, available_at timestamp_ntz")
    got = {r.name: r.reasons for r in gates.collection_gate(frame, ["name"], ["market", "macro"], "market").select("reasons", "name").collect()}
    assert got == {"good": [], "alone": ["sources"], "twice": ["sources"], "strange": ["sources"], "ill": ["status"], "unknown": ["status"], "noted": ["issues"], "old": ["market_week"], "cutoffs": ["cutoff"]}


def test_redaction_at_any_depth(spark):
    schema = "id int, Token string, secret int, note string, inner struct<`api-key`: string, kind: string, deep: array<struct<x_token: string, url: string>>>, heads map<string, string>, counts map<string, int>"
    rows = [
        (1, "abc", 5, "call?x=1&API_KEY=abc&y=2 token=q", ("abc", "plain", [("abc", "?password=abc"), (None, None)]), {"Authorization": "abc", " Access-Token ": "abc", "url": "apikey=abc"}, {"token": 3, "n": 4}),
        (2, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    clean = gates.sanitize(frame)
    assert clean.schema.simpleString() == frame.schema.simpleString()
    one, two = clean.orderBy("id").collect()
    hidden = gates.REDACTED
    assert (one.Token, one.secret, one.note) == (hidden, None, f"call?x=1&API_KEY={hidden}&y=2 token={hidden}")
    assert one.inner["api-key"] == hidden and one.inner.kind == "plain" and [tuple(x) for x in one.inner.deep] == [(hidden, f"?password={hidden}"), (hidden, None)]
    assert one.heads == {"Authorization": hidden, " Access-Token ": hidden, "url": f"apikey={hidden}"} and one.counts == {"token": None, "n": 4}
    assert two.Token == hidden and two.note is None and two.inner is None and two.heads is None and two.counts is None
    assert "abc" not in str(one)
    told = spark.createDataFrame([("key abc.d, abcxd",)], "t string").select(gates.redact_text(F.col("t"), ("abc.d", "")).alias("t")).first().t
    assert told == f"key {hidden}, abcxd"

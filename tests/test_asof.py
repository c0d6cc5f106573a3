"""The as-of join against the rule word for word: every cutoff against every observation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import pit

FIRST = dt.datetime(2020, 1, 3, 21)
SCHEMA = "source string, series_id string, observed_period_end date, value double, released_at timestamp, available_at timestamp, vintage_date date, retrieved_at timestamp, revision_seq int, raw_sha256 string"


def by_rule(obs, calendar, include_missing=False):
    cutoffs = obs.sparkSession.range(calendar.count).select(F.col("id").alias("k"), calendar.at(F.col("id")).alias("cutoff"))
    may = (F.col("available_at").cast("timestamp") <= F.col("cutoff")) & (F.col("observed_period_end") <= F.to_date("cutoff"))
    latest = obs.join(F.broadcast(cutoffs), may).groupBy(*pit.PERIOD, "k").agg(F.max(F.struct(*pit.REVISION, "value")).alias("r"))
    if not include_missing:
        latest = latest.filter(F.col("r.value").isNotNull())
    best = latest.groupBy("source", "series_id", "k").agg(F.max(F.struct("observed_period_end", "r")).alias("b"))
    return best.select("source", "series_id", "k", "b.observed_period_end", *[F.col(f"b.r.{c}").alias(c) for c in [*pit.REVISION, "value"]])


def observation(series, period, value, at, seq):
    return ("s", series, period, value, at, at, at.date(), at, seq, f"{series}-{period}-{seq}")


@pytest.mark.parametrize("include_missing", [False, True])
def test_asof_join_equals_the_rule(spark, include_missing):
    draw, rows = random.Random(3), []
    for n in range(60):
        series, period = draw.choice("ab"), dt.date(2020, 1, 1) + dt.timedelta(14 * draw.randrange(12))
        at = dt.datetime(2020, 1, 1) + dt.timedelta(hours=draw.randrange(24 * 200))
        rows.append(observation(series, period, None if draw.random() < 0.3 else float(n), at, n))
    obs = spark.createDataFrame(rows, SCHEMA)
    calendar = pit.WeeklyCalendar(FIRST, 30)
    got, want = (sorted(map(tuple, f(obs, calendar, include_missing).collect()), key=str) for f in (pit.asof_join, by_rule))
    assert got == want and got


def test_withdrawn_periods_are_not_spread_over_all_cutoffs(spark, monkeypatch):
    """Every week a period is published, withdrawn and published again, and the next one lasts: few cutoffs are theirs."""
    rows = []
    for n in range(300):
        at = FIRST + dt.timedelta(7 * n, hours=-3)
        rows += [observation("a", at.date(), 1.0, at, 0)]
        if n % 2 == 0:  # withdrawn later, published again at the end
            rows += [observation("a", at.date(), None, at + dt.timedelta(7 * 3), 1), observation("a", at.date(), 2.0, at + dt.timedelta(7 * 5), 2)]
    obs = spark.createDataFrame(rows, SCHEMA)
    calendar, spread = pit.WeeklyCalendar(FIRST, 300), []
    explode = F.explode

    def counted(column):
        spread.append(column)
        return explode(column)

    monkeypatch.setattr(pit.F, "explode", counted)
    out = pit.asof_join(obs, calendar)
    assert out.count() == 300 and {r.observed_period_end for r in out.filter("k = 299").collect()} == {(FIRST + dt.timedelta(7 * 299)).date()}
    plan = out._jdf.queryExecution().toString()
    assert "outdated" in plan and len(spread) == 1

"""Incremental forms of the weekly operators in Structured Streaming.

Every function takes a streaming (or batch) DataFrame and gives a transformed one, or starts a query over what is there
now; checkpoints go below the shared folder. Event times must be TIMESTAMP. A run over the same input in any number of
micro-batches gives the table of the batch operator, but for what a watermark drops.

Defined results: rows without an event time are left out; ties within a key are decided by the value; an empty stream
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.streaming.generations import Generations

#: Friday is the last day of a week: windows run from Saturday 00:00 UTC, counted from Thursday 1970-01-01.
WEEK, FRIDAY_START = "7 days", "2 days"
STATES = ("risk_on", "transition", "risk_off")


def run_now(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run ``each`` over all that is there now, micro-batch by micro-batch, and stop. A batch that is retried has the same id."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def _written_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so that a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def weekly_totals(events: DataFrame, ts: str, key: str, value: str, delay: str = "1 day") -> DataFrame:
    """(key, week_end, n, total) in tumbling weeks; rows later than ``delay`` may be dropped."""
    timed = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    week = F.window(F.col(ts), WEEK, WEEK, FRIDAY_START)
    return timed.groupBy(F.col(key), week).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("window.end").alias("week_end"), "n", "total")


def rolling_day(events: DataFrame, ts: str, key: str, step: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(key, until, n): events of the day before each step."""
    timed = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    return timed.groupBy(F.col(key), F.window(F.col(ts), "1 day", step)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.end").alias("until"), "n")


def once(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of every natural key: replays that overlap by less than ``delay`` are dropped."""
    return events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def latest(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest revision of every key; a NULL value is a tombstone and stays one."""
    order = Window.partitionBy(*keys).orderBy(F.col("revision_seq").desc())
    return revisions.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def collect_revisions(arrivals: DataFrame, keys: list[str], value: str, arrived: str, path: str, checkpoint: str) -> DataFrame:
    """Append every new or changed value of a key as a revision that is available from its arrival on, never before.

    A batch is compared with the last value of each key, a table of its own of which every batch leaves a generation, not
    with all revisions ever written. An equal value adds nothing, and a key that a batch does not name is not deleted. A
    batch replaces its own folder when it is retried. Returns the table of revisions.
    """
    spark = arrivals.sparkSession
    types = dict(arrivals.dtypes)
    named = ", ".join(f"{k} {types[k]}" for k in keys)
    schema = f"{named}, {value} {types[value]}, available_at timestamp, revision_seq int, batch int"
    last = Generations(spark, f"{path}-last", f"{named}, {value} {types[value]}, revision_seq int")

    def revise(batch: DataFrame, number: int) -> None:
        old = last.current(before=number).select(*keys, F.col(value).alias("_old"), F.col("revision_seq").alias("_seq"))
        rows = batch.filter(F.col(arrived).isNotNull()).select(*keys, value, F.col(arrived).alias("available_at"))
        rows = rows.join(old, keys, "left").withColumn("_seq", F.coalesce("_seq", F.lit(-1)))
        order = Window.partitionBy(*keys).orderBy("available_at", value)
        first = F.row_number().over(order) == 1
        before = F.when(first, F.col("_old")).otherwise(F.lag(value).over(order))
        new = (first & (F.col("_seq") == -1)) | ~F.col(value).eqNullSafe(before)
        changed = rows.withColumn("_new", new).filter("_new")
        revised = changed.withColumn("revision_seq", (F.col("_seq") + F.row_number().over(order)).cast("int"))
        folder = f"{path}/batch={number}"
        revised.select(*keys, value, "available_at", "revision_seq").write.mode("overwrite").parquet(folder)
        newest = spark.read.schema(schema).parquet(folder).select(*keys, value, "revision_seq")
        last.publish(number, lambda known: latest(known.unionByName(newest), keys))

    run_now(arrivals, revise, checkpoint)
    return spark.read.schema(schema).parquet(path).drop("batch")


def closed_weeks(rows: DataFrame, week: str, cutoff: str) -> DataFrame:
    """Rows of weeks that were over when their batch was cut; those of a week that was still open are left out for good."""
    return rows.filter(F.col(week) <= F.col(cutoff))


def label_machine(scored: DataFrame, hysteresis: float = 0.15, start: str = "transition") -> DataFrame:
    """(series_id, week, state) of a stream of (series_id, week, risk_score, lower, upper), with the state kept by series.

    Weeks must come in order from batch to batch; within a batch they are sorted. A week that is not after the last one
    seen is late: it was labelled before and gives no row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else (start, None)
        rows = pd.concat(list(frames)).sort_values("week")
        weeks, labels = [], []
        for week, v, low, high in zip(rows["week"], rows["risk_score"], rows["lower"], rows["upper"], strict=True):
            if last is not None and week <= last:
                continue
            last = week
            if v == v and v is not None:
                margin = (high - low) * hysteresis
                if now == STATES[1]:
                    now = STATES[2] if v <= low else STATES[0] if v >= high else now
                elif now == STATES[0]:
                    now = STATES[2] if v <= low - margin else STATES[1] if v < high - margin else now
                else:
                    now = STATES[0] if v >= high + margin else STATES[1] if v > low + margin else now
            weeks.append(week)
            labels.append(now)
        state.update((now, last))
        yield pd.DataFrame({"series_id": [key[0]] * len(weeks), "week": weeks, "state": labels})

    rows = scored.filter("week IS NOT NULL").select("series_id", "week", "risk_score", "lower", "upper")
    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, week date, state string", "state string, last date", "append", "NoTimeout")


def stream_table(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some files a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def written(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The appended rows of a stream over all that is there now, as a table."""
    run_now(stream, _written_by_batch(path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path).drop("batch")


def counted(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The whole result of a streaming aggregation over all that is there now; every batch publishes a generation."""
    spark = stream.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    published = Generations(spark, path, schema)

    def write(batch: DataFrame, number: int) -> None:
        if not published.publish(number, lambda _: batch):
            batch.write.format("noop").mode("overwrite").save()  # the state of the batch has yet to be written

    run_now(stream, write, checkpoint, mode="complete")
    return published.current()


def run_lengths(labelled: DataFrame, ts: str = "ts", gap: str = "28 days", delay: str = "0 days") -> DataFrame:
    """(series_id, week, state, duration) of a stream of (series_id, ts, state): the weeks spent in the state so far.

    The run is kept by series. A series that is silent for longer than ``gap`` loses its state when the watermark, ``delay``
    behind the latest time of all series, has passed that; what comes later starts a new run. Weeks must come in order from
    batch to batch; within a batch they are sorted. A week that is not after the last one seen, or not after the watermark,
    is late and gives no row.
    """
    silence = pd.Timedelta(gap)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, length, last = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for at, label in zip(rows["ts"], rows["state"], strict=True):
            if last is not None and at <= last:
                continue
            same = label == now and (last is None or at - last <= silence)
            now, length, last = label, length + 1 if same else 1, at
            out.append((key[0], at.date(), label, length))
        state.update((now, length, last))
        until = int((pd.Timestamp(last) + silence).timestamp() * 1000) + 1
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["series_id", "week", "state", "duration"])

    rows = labelled.filter(F.col(ts).isNotNull() & F.col("state").isNotNull()).select("series_id", F.col(ts).alias("ts"), "state").withWatermark("ts", delay)
    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, week date, state string, duration long", "state string, length long, last timestamp", "append", "EventTimeTimeout")


def deltas(revisions: DataFrame, key: str, group: str, week: str, value: str, seq: str) -> DataFrame:
    """(group, week, dn, dtotal) of a stream of revisions of single rows: what each does to its week.

    The last value of every key is kept. A first value adds itself, a changed one takes the old one out of its week and
    puts the new one in, and a NULL value, a tombstone, takes it out. A revision that is not after the last one of its key
    gives nothing, so replays are harmless.
    """

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, where, seen, known = state.get if state.exists else (None, None, None, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if seen is not None and r.seq <= seen:
                continue
            if known:
                out.append((where, at[0], -1, -at[1]))
            known = r.value is not None and r.value == r.value
            where, at, seen = r.grp, (r.week, float(r.value) if known else 0.0), r.seq
            if known:
                out.append((where, at[0], 1, at[1]))
        state.update((at, where, seen, known))
        yield pd.DataFrame(out, columns=["grp", "week", "dn", "dtotal"])

    rows = revisions.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(group).cast("string").alias("grp"), F.col(week).cast("date").alias("week"), F.col(value).cast("double").alias("value"), F.col(seq).cast("long").alias("seq"))
    found = rows.groupBy("key").applyInPandasWithState(
        step, "grp string, week date, dn long, dtotal double", "at struct<week:date,value:double>, grp string, seq long, known boolean", "append", "NoTimeout"
    )
    return found.withColumnRenamed("grp", group)


def net_weeks(revisions: DataFrame, key: str, group: str, week: str, value: str, seq: str, path: str, checkpoint: str) -> DataFrame:
    """(group, week, n, total) of the rows that stand, by a stream of their revisions, over all that is there now.

    Two queries: the first turns revisions into deltas, the second keeps running sums of these in update mode and publishes
    each batch's changed weeks over the generation before. A withdrawal takes a row back out of a week that was published,
    and a week without rows disappears.
    """
    spark = revisions.sparkSession
    stream = deltas(revisions, key, group, week, value, seq)
    schema = ", ".join(f"{n} {t}" for n, t in stream.dtypes)
    run_now(stream, _written_by_batch(f"{path}-deltas"), f"{checkpoint}/deltas")
    changes = spark.readStream.schema(f"{schema}, batch int").option("maxFilesPerTrigger", 1000).parquet(f"{path}-deltas")
    sums = changes.groupBy(group, "week").agg(F.sum("dn").alias("n"), F.sum("dtotal").alias("total"))
    published = Generations(spark, path, f"{group} string, week date, n long, total double")

    def merge(batch: DataFrame, number: int) -> None:
        folder = f"{path}-changed/batch={number}"
        batch.write.mode("overwrite").parquet(folder)  # once, as it writes the state too
        changed = spark.read.schema(batch.schema).parquet(folder)
        published.publish(number, lambda known: known.join(changed, [group, "week"], "left_anti").unionByName(changed.filter("n > 0")))

    run_now(sums, merge, f"{checkpoint}/sums", mode="update")
    return published.current()

"""Point-in-time operators over bitemporal observations.

An observation is (source, series_id, observed_period_end, value, available_at, vintage_date, revision_seq, retrieved_at,
raw_sha256); a NULL value is a tombstone, a revision that withdraws the period. Every order is total.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = ["source", "series_id", "observed_period_end"]
REVISION = ["available_at", "vintage_date", "revision_seq", "retrieved_at", "raw_sha256"]
#: Statuses from the mildest to the most severe.
HEALTH = ["ok", "stale", "unavailable", "degraded", "revision_gap", "quota_exhausted", "rights_unconfirmed", "schema_changed", "license_blocked"]


def severity(status: Column, order: list[str] = HEALTH) -> Column:
    """Place of a status in ``order``. An unknown one is more severe than all; NULL, no status, has none."""
    place = F.array_position(F.array(*map(F.lit, order)), status)
    return F.when(status.isNotNull(), F.when(place > 0, place - 1).otherwise(len(order)))


def instant(at: Column) -> Column:
    """The instant of a time; dates and times without a zone are UTC, whatever the session's zone is."""
    plain = at.cast("timestamp_ntz")
    parts = [F.year(plain), F.month(plain), F.day(plain), F.hour(plain), F.minute(plain), F.date_part(F.lit("SECOND"), plain)]
    return F.when(F.typeof(at).isin("timestamp_ntz", "date"), F.make_timestamp_ltz(*parts, F.lit("UTC"))).otherwise(at.cast("timestamp"))


def utc_day(at: Column) -> Column:
    """The UTC date of an instant."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(at) / 86_400).cast("int"))


def _fixed(at: dt.datetime) -> Column:
    """A time without a zone as the instant in UTC."""
    return F.timestamp_micros(F.lit(round(at.replace(tzinfo=at.tzinfo or dt.UTC).timestamp() * 1_000_000)))


def normalize_revisions(obs: DataFrame) -> DataFrame:
    """Number the revisions of every period from 0; earlier numbers are ignored."""
    order = Window.partitionBy(*PERIOD).orderBy("available_at", "vintage_date", "raw_sha256", F.col("value").asc_nulls_first(), "retrieved_at")
    return obs.withColumn("revision_seq", (F.row_number().over(order) - 1).cast("int"))


def last_of(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one aggregate with map-side combine instead of a sort."""
    rest = [c for c in obs.columns if c not in keys]
    best = obs.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(obs.columns)


def sequence_revisions(obs: DataFrame) -> DataFrame:
    """Drop repeats of a revision, the last retrieved wins, then number the revisions.

    Repeats lie in the same period, so one shuffle by period and one sort serve both: the winner comes first of its repeats.
    """
    same = ["available_at", "vintage_date", "raw_sha256"]
    rest = [c for c in obs.columns if c not in [*PERIOD, *same, "retrieved_at", "revision_seq"]]
    period = Window.partitionBy(*PERIOD)
    order = period.orderBy(*same, *[F.col(c).desc() for c in ["retrieved_at", "revision_seq", *rest]])
    repeat = F.row_number().over(order) > 1
    for c in same:  # column by column, as a struct of them would be shuffled too
        repeat = repeat & F.lag(c).over(order).eqNullSafe(F.col(c))
    firsts = obs.withColumn("_repeat", repeat).filter(~F.col("_repeat"))
    return firsts.withColumn("revision_seq", (F.row_number().over(period.orderBy(*same)) - 1).cast("int")).select(obs.columns)


def index_by_natural_key(obs: DataFrame) -> DataFrame:
    return last_of(obs, [*PERIOD, "vintage_date", "available_at"], ["retrieved_at", "revision_seq", "raw_sha256"])


def latest_by_period(obs: DataFrame) -> DataFrame:
    return last_of(obs, PERIOD, ["available_at", "vintage_date", "revision_seq", "retrieved_at", "raw_sha256"])


def snapshot_diff(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a full response against the stored ones, with kind added, changed, unchanged or removed."""
    old = existing.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_old"))
    new = incoming.select(*keys, *values, F.lit(True).alias("_new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"old_{v}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return old.join(new, keys, "full").withColumn("kind", kind).drop("_old", "_new")


def snapshot_mode(diff: DataFrame, group: list[str], available: str | None = None, retrieved: str | None = None) -> DataFrame:
    """Per group: counts of each kind, the mode, whether the response is degraded, and how many rows are stored.

    A group without history is stored in full, else the added and changed rows. It is degraded, and nothing is stored, if a
    period vanished, or if a change was ``retrieved`` no later than what it changes was ``available``.
    """
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    unsafe = (F.col("kind") == "changed") & (instant(F.col(retrieved)) <= instant(F.col(available))) if available else F.lit(False)
    counts = diff.groupBy(*group).agg(*[count(k).alias(f"n_{k}") for k in ("added", "changed", "unchanged", "removed")], F.count(F.when(unsafe, 1)).alias("n_unsafe"))
    stored = F.col("n_changed") + F.col("n_unchanged") + F.col("n_removed")
    degraded = (F.col("n_removed") > 0) | (F.col("n_unsafe") > 0)
    return counts.withColumns(
        {
            "mode": F.when(stored == 0, "full").otherwise("delta"),
            "status": F.when(degraded, "degraded").otherwise("ok"),
            "n_stored": F.when(degraded, F.lit(0)).otherwise(F.col("n_added") + F.col("n_changed")),
        }
    )


def prospective_revisions(diff: DataFrame, series: list[str], period: str, available: str, retrieved: str) -> DataFrame:
    """Added and changed rows with reason, available_at and reported_available_at.

    A changed value, and an added period before the latest stored one (a backfill), become available when they were
    ``retrieved``, and reported_available_at keeps what the provider says; a new period keeps its own ``available``.
    """
    latest = F.max(F.when(F.col("kind") != "added", F.col(period))).over(Window.partitionBy(*series))
    backfill = (F.col("kind") == "added") & F.coalesce(F.col(period) < latest, F.lit(False))
    reason = F.when(F.col("kind") == "changed", "provider_value_changed").when(backfill, "historical_backfill")
    own, found = instant(F.col(available)), instant(F.col(retrieved))
    rows = diff.withColumns({"reason": reason, "_own": own, "_found": found}).filter(F.col("kind").isin("added", "changed"))
    moved = F.col("reason").isNotNull()
    times = {"available_at": F.when(moved, F.col("_found")).otherwise(F.col("_own")), "reported_available_at": F.when(moved, F.col("_own"))}
    return rows.withColumns(times).drop("_own", "_found")


def plan_windows(obs: DataFrame, history_start: dt.date, cutoff: dt.date, keys: list[str] = ["source", "series_id"], overlap_days: int = 1) -> DataFrame:  # noqa: B006
    """Next inclusive realtime window of each key: (keys, last_vintage, window_start, window_end, mode).

    With one overlap day the last vintage is asked for again, with more the days before it too, but none before
    ``history_start``. A key without a vintage is asked for in full, from ``history_start``. A vintage after ``cutoff``
    fails the job.
    """
    last = obs.groupBy(*keys).agg(F.max("vintage_date").alias("last_vintage"))
    late = F.raise_error(F.lit("the cutoff is before the last successful collection"))
    start = F.when(F.col("last_vintage") > F.lit(cutoff), late.cast("date")).otherwise(F.greatest(F.date_sub("last_vintage", overlap_days - 1), F.lit(history_start)))
    mode = F.when(F.col("last_vintage").isNull(), "full").otherwise("delta")
    return last.select(*keys, "last_vintage", F.coalesce(start, F.lit(history_start)).alias("window_start"), F.lit(cutoff).alias("window_end"), mode.alias("mode"))


def combine_health(statuses: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The most severe status of each key; of several unknown ones the last by name."""
    worst = F.max(F.when(F.col(status).isNotNull(), F.struct(severity(F.col(status)).alias("at"), F.col(status).alias("s"))))
    return statuses.groupBy(*keys).agg(F.coalesce(worst["s"], F.lit("ok")).alias(status))


def merge_results(results: DataFrame) -> DataFrame:
    """Merge collection results (source, status, records, issues): summed counts, ordered distinct issues, worst status; rows count only if ok."""
    return results.groupBy("source").agg(
        F.max(F.struct(severity(F.col("status")).alias("at"), F.col("status").alias("s")))["s"].alias("status"),
        F.sum(F.when(F.col("status") == "ok", F.col("records")).otherwise(F.lit(0))).alias("records"),
        F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("issues"),
    )


def expansion(existing: DataFrame, configured: list[str], keys: list[str], series: str = "series_id") -> DataFrame:
    """(keys, series) that a grown configuration still lacks: only where what exists is a strict subset of it.

    A key that holds a series which is not configured is no expansion and gives no row. The configuration is a short list.
    """
    wanted = F.array(*[F.lit(s) for s in sorted(set(configured))])
    held = existing.groupBy(*keys).agg(F.collect_set(F.when(F.col(series).isin(configured), F.col(series))).alias("held"), F.max((~F.col(series).isin(configured)).cast("int")).alias("strange"))
    return held.filter("strange = 0").select(*keys, F.explode(F.array_except(wanted, F.col("held"))).alias(series))


def completeness(obs: DataFrame, expected: DataFrame, cutoffs: int, share: float = 0.9) -> DataFrame:
    """Per expected series: weeks seen, coverage of the weekly cutoffs, and whether that is enough."""
    seen = obs.groupBy("series_id").agg(F.countDistinct(F.trunc("observed_period_end", "week")).alias("weeks_seen"))
    n = F.coalesce("weeks_seen", F.lit(0))
    return expected.join(seen, "series_id", "left").select("series_id", n.alias("weeks_seen"), (n / cutoffs).alias("coverage"), (n >= share * cutoffs).alias("complete"))


def source_rows(obs: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Per source: latest availability, period range, and counts of usable and all rows."""
    usable = instant(F.col("available_at")) <= _fixed(cutoff)
    return obs.groupBy("source").agg(
        F.max(F.when(usable, F.col("available_at"))).alias("latest_available"), F.min(F.when(usable, F.col("observed_period_end"))).alias("first_period"),
        F.max(F.when(usable, F.col("observed_period_end"))).alias("last_period"), F.count(F.when(usable, 1)).alias("n_usable"), F.count(F.lit(1)).alias("n_rows"),
    )


def rolling_budget(requests: DataFrame, key: str, at: str, tie: str, cap: int, seconds: int = 86_400) -> DataFrame:
    """Requests in the last 24 hours (the lower bound is strict), whether the cap is met, and when the next one is free."""
    micros = F.unix_micros(instant(F.col(at)))
    order = Window.partitionBy(key).orderBy("_t")
    used = F.count(F.lit(1)).over(order.rangeBetween(-seconds * 1_000_000 + 1, 0))
    earlier = F.lag(at, cap - 1).over(Window.partitionBy(key).orderBy("_t", tie))
    free = F.when(F.col("used") >= cap, earlier + F.expr(f"interval {seconds} seconds"))
    return requests.withColumn("_t", micros).withColumn("used", used).withColumns({"over_cap": F.col("used") > cap, "next_available": free}).drop("_t")


def redact(text: Column, keys: tuple[str, ...] = ("api_key", "token", "secret", "password")) -> Column:
    """Replace values of credential keys in JSON or query strings."""
    names = "|".join(keys)
    json = F.regexp_replace(text, rf'"({names})"\s*:\s*"[^"]*"', '"$1":"[redacted]"')
    return F.regexp_replace(json, rf"\b({names})=[^&\s\"]*", "$1=[redacted]")


def year_chunks(ranges: DataFrame, years: int = 4) -> DataFrame:
    """Split (first_date, last_date) into contiguous ranges of so many years."""
    starts = F.explode(F.sequence("first_date", "last_date", F.expr(f"interval {years} years"))).alias("chunk_start")
    return ranges.select("*", starts).withColumn("chunk_end", F.least(F.date_sub(F.add_months("chunk_start", 12 * years), 1), F.col("last_date")))


def date_available(vintage: Column, hour: int = 18, zone: str = "America/New_York") -> Column:
    """The instant of 18:00 in New York on the vintage's day, so a Friday release misses the Friday 16:00 cutoff."""
    return F.make_timestamp_ltz(F.year(vintage), F.month(vintage), F.day(vintage), F.lit(hour), F.lit(0), F.lit(0), F.lit(zone))


@dataclass(frozen=True)
class WeeklyCalendar:
    """Cutoffs every seven days; index arithmetic replaces a range join against the calendar."""

    first: dt.datetime
    count: int

    def first_index(self, available_at: Column, period: Column) -> Column:
        """Index of the first cutoff at or after ``available_at`` whose UTC date is at or after ``period``."""
        week = 7 * 86_400 * 1_000_000
        zero = int(self.first.replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
        by_time = F.ceil((F.unix_micros(instant(available_at)) - zero) / week)
        by_date = F.ceil(F.datediff(period, F.lit(self.first.date())) / 7)
        return F.greatest(by_time, by_date, F.lit(0)).cast("long")

    def at(self, index: Column) -> Column:
        return F.timestamp_seconds(F.lit(int(self.first.replace(tzinfo=dt.UTC).timestamp())) + index * (7 * 86_400))


def asof_join(obs: DataFrame, calendar: WeeklyCalendar, include_missing: bool = False) -> DataFrame:
    """(source, series_id, k, observed_period_end, value, revision key): the newest known period of each series at every cutoff.

    A revision enters at the first cutoff that may see it. Periods that are never withdrawn need no interval: the answer
    at a cutoff is the running maximum of (period, revision). Only revisions of withdrawn periods are spread over the
    cutoffs for which they are the period's last word, and only up to where a newer lasting period is known, as they
    are not the newest from there on. No cutoff meets all observations.
    """
    key, series = REVISION, ["source", "series_id"]
    entry = obs.withColumn("k", calendar.first_index(F.col("available_at"), F.col("observed_period_end"))).filter(F.col("k") < calendar.count)
    revision = F.struct(*key, "value")
    collapsed = entry.groupBy(*PERIOD, "k").agg(F.max(revision).alias("r"))
    period = Window.partitionBy(*PERIOD)
    marked = collapsed.withColumns(
        {
            "withdrawn": F.lit(False) if include_missing else F.max(F.col("r.value").isNull()).over(period),
            "k_end": F.coalesce(F.lead("k").over(period.orderBy("k")), F.lit(calendar.count).cast("long")),
        }
    )
    best = F.struct("observed_period_end", "r")
    lasting = marked.filter(~F.col("withdrawn")).groupBy(*series, "k").agg(F.max(best).alias("b"))
    order = Window.partitionBy(*series).orderBy("k")
    running = lasting.withColumns(
        {"b": F.max("b").over(order.rowsBetween(Window.unboundedPreceding, 0)), "k_end": F.coalesce(F.lead("k").over(order), F.lit(calendar.count).cast("long"))}
    )
    spread = F.explode(F.sequence(F.col("k"), F.col("k_end") - 1)).alias("k")
    known = running.select(*series, "b", spread)
    if not include_missing:
        day = F.datediff("observed_period_end", F.lit("1970-01-01").cast("date"))
        newer = Window.partitionBy(*series).orderBy(day.desc()).rangeBetween(Window.unboundedPreceding, -1)
        outdated = marked.withColumn("outdated", F.min(F.when(~F.col("withdrawn"), F.col("k"))).over(newer))
        gone = outdated.filter(F.col("withdrawn") & F.col("r.value").isNotNull())
        gone = gone.withColumn("k_end", F.least("k_end", "outdated")).filter("k < k_end").select(*series, best.alias("b"), spread)
        known = known.unionByName(gone).groupBy(*series, "k").agg(F.max("b").alias("b"))
    return known.select(*series, "k", "b.observed_period_end", *[F.col(f"b.r.{c}").alias(c) for c in [*key, "value"]])


def asof_panel(obs: DataFrame, required: DataFrame, calendar: WeeklyCalendar, max_age_days: int, include_missing: bool = False) -> DataFrame:
    """Every required (source, series_id) at every cutoff, with age, release lag, fill flag and status."""
    grid = required.select("source", "series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(calendar.count - 1).cast("long"))).alias("k"))
    joined = grid.join(asof_join(obs, calendar, include_missing), ["source", "series_id", "k"], "left").withColumn("cutoff", calendar.at(F.col("k")))
    day = utc_day(F.col("cutoff"))
    available = instant(F.col("available_at"))
    age = F.unix_seconds("cutoff") - F.unix_seconds(available)
    status = F.when(available.isNull(), "unavailable").when(age > max_age_days * 86_400, "stale").otherwise("ok")
    return joined.withColumns(
        {
            "age_days": F.datediff(day, "observed_period_end"),
            "release_lag_days": F.datediff(utc_day(available), "observed_period_end"),
            "is_filled": F.col("observed_period_end") < day,
            "quality_status": status,
        }
    ).drop("k")

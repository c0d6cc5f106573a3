"""Point-in-time queries on the driver tables, with DuckDB SQL for each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tideline.operators import pit
from tideline.plans.registry import register
from tideline.session import read_table
from tideline.sources.observations import CUTOFFS_SQL, OBS_SQL, order_calendar, order_observations

OBS_DATES = ("observed_period_end", "available_at", "vintage_date", "retrieved_at")
CUTOFF = dt.datetime(1998, 1, 2, 21)
PERIOD = "source, series_id, observed_period_end"
KEY = "available_at, vintage_date, revision_seq, retrieved_at, raw_sha256"


@register(
    "r01_normalize_revisions",
    f"WITH {OBS_SQL} SELECT source, series_id, observed_period_end, value, available_at, raw_sha256, row_number() OVER (PARTITION BY {PERIOD} ORDER BY available_at, vintage_date, raw_sha256, value NULLS FIRST, retrieved_at) - 1 AS revision_seq FROM obs",
    dates=("observed_period_end", "available_at"),
)
def r01(spark, sf_dir):
    found = pit.normalize_revisions(order_observations(spark, sf_dir))
    return found.select("source", "series_id", "observed_period_end", "value", "available_at", "raw_sha256", F.col("revision_seq").cast("long"))


@register(
    "r02_sequence_revisions",
    f"WITH {OBS_SQL}, u AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY {PERIOD}, available_at, vintage_date, raw_sha256 ORDER BY retrieved_at DESC, revision_seq DESC, value DESC NULLS LAST) = 1) SELECT series_id, observed_period_end, raw_sha256, value, row_number() OVER (PARTITION BY {PERIOD} ORDER BY available_at, vintage_date, raw_sha256, value NULLS FIRST) - 1 AS revision_seq FROM u",
    dates=("observed_period_end",),
)
def r02(spark, sf_dir):
    found = pit.sequence_revisions(order_observations(spark, sf_dir))
    return found.select("series_id", "observed_period_end", "raw_sha256", "value", F.col("revision_seq").cast("long"))


def _last(keys: str, order: str) -> str:
    ordered = ", ".join(f"{c.strip()} DESC" for c in order.split(","))
    return f"WITH {OBS_SQL} SELECT series_id, observed_period_end, available_at, raw_sha256, value FROM obs QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {ordered}, value DESC NULLS LAST) = 1"


_SLIM = ["series_id", "observed_period_end", "available_at", "raw_sha256", "value"]


@register("r03_natural_key", _last(f"{PERIOD}, vintage_date, available_at", "retrieved_at, revision_seq, raw_sha256"), dates=("observed_period_end", "available_at"))
def r03(spark, sf_dir):
    return pit.index_by_natural_key(order_observations(spark, sf_dir)).select(_SLIM)


@register("r04_latest_by_period", _last(PERIOD, KEY), dates=("observed_period_end", "available_at"))
def r04(spark, sf_dir):
    return pit.latest_by_period(order_observations(spark, sf_dir)).select(_SLIM)


def _snapshots(spark, sf_dir):
    """Order values by priority and day: the stored ones are of finished lines, the new response is of all but returned lines."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("period"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("month", F.trunc("period", "month"))

    def total(df, at):
        return df.groupBy("series_id", "month", "period").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.max("l_shipdate").alias(at))

    old = total(rows.filter("l_linestatus = 'F'"), "available_at")
    new = total(rows.filter("l_returnflag <> 'R'"), "retrieved_at")
    diff = pit.snapshot_diff(old.drop("available_at"), new.drop("retrieved_at"), ["series_id", "month", "period"], ["value"])
    key = ["series_id", "month", "period"]
    return diff.join(old.drop("value"), key, "left").join(new.drop("value"), key, "left")


_DIFF = """o AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS period, l_extendedprice AS v, l_linestatus AS st, l_returnflag AS rf, l_shipdate AS sh FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT series_id, period, round(sum(v), 2) AS old_value, max(sh) AS available_at FROM o WHERE st = 'F' GROUP BY 1, 2),
b AS (SELECT series_id, period, round(sum(v), 2) AS value, max(sh) AS retrieved_at FROM o WHERE rf <> 'R' GROUP BY 1, 2),
d AS (SELECT series_id, CAST(date_trunc('month', period) AS DATE) AS month, period, old_value, value, available_at, retrieved_at,
 CASE WHEN available_at IS NULL THEN 'added' WHEN retrieved_at IS NULL THEN 'removed' WHEN old_value = value THEN 'unchanged' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (series_id, period))"""


@register("r05_j10_snapshot_diff", f"WITH {_DIFF} SELECT series_id, period, old_value, value, kind FROM d", dates=("period",))
def r05(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("series_id", "period", "old_value", "value", "kind")


@register(
    "r05_snapshot_mode",
    f"""WITH {_DIFF}, c AS (SELECT series_id, month, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'changed') AS n_changed, count(*) FILTER (kind = 'unchanged') AS n_unchanged, count(*) FILTER (kind = 'removed') AS n_removed,
 count(*) FILTER (kind = 'changed' AND retrieved_at <= available_at) AS n_unsafe FROM d GROUP BY 1, 2)
SELECT *, CASE WHEN n_changed + n_unchanged + n_removed = 0 THEN 'full' ELSE 'delta' END AS mode, CASE WHEN n_removed + n_unsafe > 0 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN n_removed + n_unsafe > 0 THEN 0 ELSE n_added + n_changed END AS n_stored FROM c""",
    dates=("month",),
)
def r05_mode(spark, sf_dir):
    return pit.snapshot_mode(_snapshots(spark, sf_dir), ["series_id", "month"], "available_at", "retrieved_at")


@register(
    "r06_prospective_revision",
    f"""WITH {_DIFF}, l AS (SELECT *, max(CASE WHEN kind <> 'added' THEN period END) OVER (PARTITION BY series_id) AS latest FROM d),
r AS (SELECT *, CASE WHEN kind = 'changed' THEN 'provider_value_changed' WHEN period < latest THEN 'historical_backfill' END AS reason FROM l WHERE kind IN ('added', 'changed'))
SELECT series_id, period, old_value, value, kind, reason, retrieved_at AS available_at, CASE WHEN reason IS NOT NULL THEN CAST(period AS TIMESTAMP) END AS reported_available_at FROM r""".replace("retrieved_at AS available_at,", "CASE WHEN reason IS NULL THEN CAST(period AS TIMESTAMP) ELSE retrieved_at END AS available_at,"),
    dates=("period", "available_at", "reported_available_at"),
)
def r06(spark, sf_dir):
    """The provider reports a period as available on its day."""
    found = pit.prospective_revisions(_snapshots(spark, sf_dir), ["series_id"], "period", "period", "retrieved_at")
    return found.select("series_id", "period", "old_value", "value", "kind", "reason", "available_at", "reported_available_at")


@register(
    "r07_plan_windows",
    f"""WITH {OBS_SQL}, l AS (SELECT source, series_id, observed_period_end, max(vintage_date) AS last_vintage FROM obs GROUP BY 1, 2, 3)
SELECT *, greatest(last_vintage - 6, DATE '1997-01-01') AS window_start, DATE '2003-01-03' AS window_end, 'delta' AS mode FROM l""",
    dates=("observed_period_end", "last_vintage", "window_start", "window_end"),
)
def r07(spark, sf_dir):
    """The next window of every period, a week of overlap with its last vintage."""
    return pit.plan_windows(order_observations(spark, sf_dir), dt.date(1997, 1, 1), dt.date(2003, 1, 3), ["source", "series_id", "observed_period_end"], overlap_days=7)


_STATUS = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'stale' WHEN 'signup' THEN 'unavailable' WHEN 'purchase' THEN 'rights_unconfirmed' ELSE 'schema_changed' END"
_SEVERITY = "list_position(['ok', 'stale', 'unavailable', 'degraded', 'revision_gap', 'quota_exhausted', 'rights_unconfirmed', 'schema_changed', 'license_blocked'], s)"


def _statuses(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS))


@register("r08_combine_health", f"SELECT user_id, CAST(ts AS DATE) AS day, arg_max(s, {_SEVERITY}) AS status FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY 1, 2", dates=("day",))
def r08(spark, sf_dir):
    return pit.combine_health(_statuses(spark, sf_dir).withColumn("day", F.col("ts").cast("date")), ["user_id", "day"])


@register(
    "r09_merge_results",
    f"SELECT CAST(user_id AS VARCHAR) AS source, arg_max(s, {_SEVERITY}) AS status, CAST(sum(CASE WHEN s = 'ok' THEN event_id % 7 ELSE 0 END) AS BIGINT) AS records, array_to_string(list_sort(list(DISTINCT event_type)), '; ') AS issues FROM (SELECT *, {_STATUS} AS s FROM events) GROUP BY 1",
    dates=(),
)
def r09(spark, sf_dir):
    return pit.merge_results(_statuses(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), "status", (F.col("event_id") % 7).alias("records"), F.col("event_type").alias("issue")))


@register(
    "r10_completeness",
    f"WITH {OBS_SQL}, e(series_id) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')), s AS (SELECT series_id, count(DISTINCT date_trunc('week', observed_period_end)) AS n FROM obs GROUP BY 1) SELECT series_id, coalesce(n, 0) AS weeks_seen, coalesce(n, 0) / 345 AS coverage, coalesce(n, 0) >= 0.9 * 345 AS complete FROM e LEFT JOIN s USING (series_id)",
    dates=(),
)
def r10(spark, sf_dir):
    expected = spark.createDataFrame([(s,) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "series_id string")
    return pit.completeness(order_observations(spark, sf_dir), expected, 345)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register(
    "r11_expansion",
    f"""WITH k AS (SELECT CAST(o_orderdate AS DATE) AS day, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT day FROM k GROUP BY 1 HAVING bool_and(s IN ({', '.join(f"'{s}'" for s in SEGMENTS)})))
SELECT day, v.s AS series_id FROM d, (SELECT unnest({SEGMENTS}) AS s) v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.day = d.day AND k.s = v.s)""",
    dates=("day",),
)
def r11(spark, sf_dir):
    """Segments that a day's orders lack, of a configuration of all five."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    return pit.expansion(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), SEGMENTS, ["day"])


@register(
    "r12_rolling_budget",
    "WITH u AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS used, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events) SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, used, used > 3 AS over_cap, CASE WHEN used >= 3 THEN strftime(e + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS next_available FROM u",
    dates=(),
)
def r12(spark, sf_dir):
    found = pit.rolling_budget(read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3)
    return found


@register(
    "r14_source_rows",
    f"WITH {OBS_SQL}, u AS (SELECT *, available_at <= TIMESTAMP '1998-01-02 21:00:00' AS ok FROM obs) SELECT source, max(available_at) FILTER (ok) AS latest_available, min(observed_period_end) FILTER (ok) AS first_period, max(observed_period_end) FILTER (ok) AS last_period, count(*) FILTER (ok) AS n_usable, count(*) AS n_rows FROM u GROUP BY 1",
    dates=("latest_available", "first_period", "last_period"),
)
def r14(spark, sf_dir):
    return pit.source_rows(order_observations(spark, sf_dir), CUTOFF)


@register(
    "r15_training_gate",
    f"WITH {OBS_SQL} SELECT series_id, max(observed_period_end) AS last_period, date_trunc('week', max(observed_period_end)) = DATE '2001-07-30' AS is_current, bool_and(value IS NOT NULL) AS all_known FROM obs GROUP BY 1",
    dates=("last_period",),
)
def r15(spark, sf_dir):
    last = F.max("observed_period_end")
    return order_observations(spark, sf_dir).groupBy("series_id").agg(
        last.alias("last_period"), (F.trunc(last, "week") == F.lit("2001-07-30").cast("date")).alias("is_current"), F.bool_and(F.col("value").isNotNull()).alias("all_known")
    )


_SECRET = "'{\"token\": \"' || md5(CAST(event_id AS VARCHAR)) || '\", \"k\": 1} ?api_key=' || md5(event_type) || '&x=1'"


@register("r16_redaction", "SELECT event_id, '{\"token\":\"[redacted]\", \"k\": 1} ?api_key=[redacted]&x=1' AS text FROM events", dates=())
def r16(spark, sf_dir):
    secret = F.concat(F.lit('{"token": "'), F.md5(F.col("event_id").cast("string")), F.lit('", "k": 1} ?api_key='), F.md5("event_type"), F.lit("&x=1"))
    return read_table(spark, sf_dir, "events").select("event_id", pit.redact(secret).alias("text"))


@register(
    "r17_year_chunks",
    "WITH r AS (SELECT o_orderpriority AS series_id, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1), c AS (SELECT *, CAST(unnest(generate_series(first_date, last_date, INTERVAL 4 YEAR)) AS DATE) AS chunk_start FROM r) SELECT *, least(CAST(chunk_start + INTERVAL 4 YEAR AS DATE) - 1, last_date) AS chunk_end FROM c",
    dates=("first_date", "last_date", "chunk_start", "chunk_end"),
)
def r17(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    ranges = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))
    return pit.year_chunks(ranges)


@register(
    "s05_date_available",
    "SELECT o_orderkey, strftime((CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 18 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS available_at FROM orders",
    dates=(),
)
def s05(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", pit.date_available(F.col("o_orderdate").cast("date")).alias("available_at"))


def _asof(include_missing: bool) -> str:
    known = "" if include_missing else "WHERE value IS NOT NULL"
    return f"""WITH {OBS_SQL}, {CUTOFFS_SQL},
e AS (SELECT cutoff, source, series_id, observed_period_end, unnest(max(struct_pack(a := available_at, b := vintage_date, c := revision_seq, d := retrieved_at, e := raw_sha256, v := value)))
      FROM obs JOIN cut ON available_at <= cutoff AND observed_period_end <= CAST(cutoff AS DATE) GROUP BY 1, 2, 3, 4),
l AS (SELECT cutoff, source, series_id, observed_period_end, a AS available_at, e AS raw_sha256, c AS revision_seq, v AS value FROM e),
n AS (SELECT * FROM l {known} QUALIFY row_number() OVER (PARTITION BY cutoff, source, series_id ORDER BY observed_period_end DESC) = 1),
q AS (SELECT DISTINCT source, series_id FROM obs)
SELECT cut.cutoff, q.series_id, n.observed_period_end, n.value, n.revision_seq, n.raw_sha256, CAST(cut.cutoff AS DATE) - n.observed_period_end AS age_days, CAST(n.available_at AS DATE) - n.observed_period_end AS release_lag_days,
 n.observed_period_end < CAST(cut.cutoff AS DATE) AS is_filled, CASE WHEN n.available_at IS NULL THEN 'unavailable' WHEN cut.cutoff - n.available_at > INTERVAL 10 DAY THEN 'stale' ELSE 'ok' END AS quality_status
FROM q CROSS JOIN cut LEFT JOIN n USING (cutoff, source, series_id)"""


def _asof_query(spark, sf_dir, include_missing):
    obs = order_observations(spark, sf_dir)
    required = obs.select("source", "series_id").distinct()
    found = pit.asof_panel(obs, required, order_calendar(spark, sf_dir), 10, include_missing)
    return found.select("cutoff", "series_id", "observed_period_end", "value", "revision_seq", "raw_sha256", F.col("age_days").cast("long"), F.col("release_lag_days").cast("long"), "is_filled", "quality_status")


@register("j01_j02_asof_join", _asof(False), dates=("cutoff", "observed_period_end"))
def j01(spark, sf_dir):
    return _asof_query(spark, sf_dir, False)


@register("j01_asof_with_tombstones", _asof(True), dates=("cutoff", "observed_period_end"))
def j01_missing(spark, sf_dir):
    return _asof_query(spark, sf_dir, True)


@register(
    "j08_training_prefix",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS s FROM orders QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1), p AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pos FROM d) SELECT a.day, a.pos, (SELECT count(*) FROM p b WHERE b.pos < a.pos - 5 AND b.s = 'F') AS n_before FROM p a",
    dates=("day",),
)
def j08(spark, sf_dir):
    from pyspark.sql import Window

    daily = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("s"))
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    prefix = F.count(F.when(F.col("s") == "F", 1)).over(order.rowsBetween(Window.unboundedPreceding, -6))
    return daily.select("day", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.coalesce(prefix, F.lit(0)).alias("n_before"))


@register(
    "j11_prior_date",
    "SELECT c_custkey, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1998-06-30') AS snapped FROM customer",
    dates=("snapped",),
)
def j11(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").filter("o_orderdate <= timestamp_ntz'1998-06-30'").groupBy("o_custkey").agg(F.max(F.col("o_orderdate").cast("date")).alias("snapped"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left").select("c_custkey", "snapped")


@register(
    "s08_read_observations",
    f"WITH {OBS_SQL} SELECT series_id, observed_period_end, available_at, raw_sha256, value FROM obs WHERE series_id IN ('1-URGENT', '5-LOW') AND available_at <= TIMESTAMP '1998-01-02 21:00:00'",
    dates=("observed_period_end", "available_at"),
)
def s08(spark, sf_dir):
    obs = order_observations(spark, sf_dir)
    return obs.filter(F.col("series_id").isin("1-URGENT", "5-LOW") & (F.col("available_at") <= F.lit("1998-01-02 21:00:00").cast("timestamp_ntz"))).select(_SLIM)

"""Composed feature tables and gates on the driver tables, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import gates, matrix
from tideline.plans import forecast_queries  # noqa: F401  its SQL is joined below
from tideline.plans.feature_queries import BENCHMARK, LAG, LNP, r6, roll, sql
from tideline.plans.forecast_queries import labelled
from tideline.plans.registry import ORACLES, register
from tideline.session import read_table
from tideline.sources.panel import NATION_PANEL_SQL, friday, nation_panel, order_panel

_OWN = [f"({ORACLES[n]})" for n in ("f01_log_return", "f02_risk_adjusted_trend", "f03_realized_vol", "f04_downside_vol", "f05_drawdown", "f06_missing_flag", "f09_f10_volume")]
_WEEK = [f"({ORACLES[n]})" for n in ("x01_positive_share", "x02_above_mean_share", "x03_x04_dispersion", "x05_pairwise_correlation", "x06_volume_breadth")]
_WEEK.append(f"(SELECT * EXCLUDE (positive_share_1w) FROM ({ORACLES['f15_breadth_acceleration']}))")


@register(
    "f21_weekly_matrix",
    sql(" SELECT * FROM (SELECT series_id, CAST(week AS VARCHAR) AS week, price, volume FROM panel) ")
    + "".join(f" JOIN {q} USING (series_id, week)" for q in _OWN)
    + f" LEFT JOIN ({ORACLES['f07_relative_return']}) USING (series_id, week)"
    + "".join(f" JOIN {q} USING (week)" for q in _WEEK),
    dates=(),
)
def f21(spark, sf_dir):
    return rounded(matrix.weekly_matrix(order_panel(spark, sf_dir), BENCHMARK), "price", "volume")


@register("f22_transition_features", f"SELECT * FROM ({ORACLES['f20_state_durations']}) JOIN ({ORACLES['f19_transition_path']}) USING (series_id, week)", dates=())
def f22(spark, sf_dir):
    frame = labelled(spark, sf_dir).select("series_id", "week", "state", "risk_score", "lower", "upper")
    return rounded(matrix.transition_features(frame).drop("risk_score", "lower", "upper"), places=8)


_AT, _ONE, _OTHERS = "2000-06-30", "NATION_0", ["NATION_1", "NATION_2", "NATION_3"]


@register(
    "f18_market_context",
    sql(
        LNP.replace("FROM panel", f"FROM panel WHERE week <= DATE '{_AT}'")
        + f", r AS (SELECT *, lnp - lag(lnp, 1) {LAG} AS r FROM p), d AS (SELECT *, CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS q FROM r), own AS (SELECT week, series_id, price, r AS log_return_1w, ({roll('stddev_pop', 'r', 13)}) * sqrt(52) AS realized_vol_13w, sqrt({roll('avg', 'q', 13)}) * sqrt(52) AS downside_vol_13w, price / ({roll('max', 'price', 52)}) - 1 AS drawdown_52w, lnp FROM d), "
        + f"x AS (SELECT o.series_id, o.week, o.lnp - b.lnp AS e FROM own o JOIN own b ON b.week = o.week AND b.series_id = '{_ONE}'), y AS (SELECT series_id, week, e - lag(e, 13) {LAG} AS e FROM x) "
        + "SELECT week, price, " + ", ".join(r6(c, c) for c in ("log_return_1w", "realized_vol_13w", "downside_vol_13w", "drawdown_52w")) + ", "
        + ", ".join(r6(f"(SELECT e FROM y WHERE y.week = own.week AND y.series_id = '{o}')", f"relative_{o}") for o in _OTHERS)
        + f" FROM own WHERE series_id = '{_ONE}' QUALIFY row_number() OVER (ORDER BY week DESC) = 1",
        NATION_PANEL_SQL,
    ),
)
def f18(spark, sf_dir):
    return rounded(matrix.market_context(nation_panel(spark, sf_dir).drop("group_id"), _ONE, _OTHERS, _AT), "price")


_START, _END = "1995-06-02", "2001-07-27"
_STATUSES = ("F", "O", "P")
_BASELINE = f"""WITH o AS (SELECT c_mktsegment AS symbol, o_orderstatus AS field, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS period, CAST(max(o_orderdate) AS DATE) AS available_day,
 round(sum(o_totalprice), 2) AS value, CASE WHEN min(o_totalprice) < 1000 THEN 'degraded' ELSE 'ok' END AS status FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
e AS (SELECT s.symbol, f.field, CASE WHEN s.symbol = 'BUILDING' THEN DATE '1998-01-02' END AS inception FROM (SELECT DISTINCT c_mktsegment AS symbol FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION SELECT 'NOTHING') s, (VALUES ('F'), ('O'), ('P')) f(field)),
w AS (SELECT symbol, field, greatest(coalesce(inception, DATE '{_START}'), DATE '{_START}') AS first FROM e),
v AS (SELECT *, coalesce(value IS NOT NULL AND status = 'ok' AND period BETWEEN DATE '{_START}' AND DATE '{_END}' AND available_day <= DATE '{_END}', false) AS good FROM o),
pe AS (SELECT symbol, period, count(*) AS held FROM v JOIN w USING (symbol, field) WHERE good GROUP BY 1, 2),
un AS (SELECT symbol, count(*) AS n_unequal FROM pe WHERE held < 3 GROUP BY 1),
se AS (SELECT symbol, field, count(*) FILTER (good) AS periods, max(period) FILTER (good) AS latest, count(*) FILTER (NOT good) AS n_invalid FROM v GROUP BY 1, 2),
j AS (SELECT symbol, field, w.first, CASE WHEN w.first IS NOT NULL THEN greatest((DATE '{_END}' - w.first) // 7 + 1, 0) END AS expected_periods, coalesce(periods, 0) AS periods, latest, coalesce(n_invalid, 0) AS n_invalid, 0 AS n_repeated, coalesce(n_unequal, 0) AS n_unequal
 FROM w FULL JOIN se USING (symbol, field) LEFT JOIN un USING (symbol)),
b AS (SELECT *, list_filter([CASE WHEN first IS NULL THEN 'unexpected' END, CASE WHEN first IS NOT NULL AND periods = 0 THEN 'missing' END, CASE WHEN periods < greatest(1, ceil(round(expected_periods * 0.9, 9))) THEN 'insufficient' END,
 CASE WHEN first IS NOT NULL AND coalesce(latest < DATE '{_END}' - 10, true) THEN 'stale' END, CASE WHEN first IS NOT NULL AND n_unequal > 0 THEN 'fields_differ' END, CASE WHEN first IS NOT NULL AND n_invalid > 0 THEN 'invalid' END], lambda x: x IS NOT NULL) AS reasons FROM j)"""


def _baseline(spark, sf_dir):
    """Weekly order values of segments by status. One segment is not expected, one starts later, one does not exist."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    day = F.col("o_orderdate").cast("date")
    obs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("symbol", F.col("o_orderstatus").alias("field"), friday(day).alias("period")).agg(
        F.max(day).alias("available_day"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.when(F.min("o_totalprice") < 1000, "degraded").otherwise("ok").alias("status")
    )
    nothing = spark.createDataFrame([("NOTHING",)], "symbol string")
    symbols = customer.filter("symbol <> 'MACHINERY'").select("symbol").distinct().unionByName(nothing)
    expected = symbols.select("symbol", F.explode(F.array(*map(F.lit, _STATUSES))).alias("field"), F.when(F.col("symbol") == "BUILDING", F.lit("1998-01-02").cast("date")).alias("inception"))
    return gates.baseline_series(obs, expected, _START, _END)


@register("r10_baseline_series", _BASELINE + " SELECT * REPLACE (array_to_string(reasons, ';') AS reasons) FROM b", dates=("first", "latest"))
def r10_series(spark, sf_dir):
    return _baseline(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ";"))


@register(
    "r10_baseline_gate",
    _BASELINE + " SELECT count(*) AS n_series, " + ", ".join(f"count(*) FILTER (list_contains(reasons, '{n}')) AS n_{n}" for n in ("unexpected", "missing", "insufficient", "stale", "fields_differ", "invalid", "repeated")) + ", bool_and(len(reasons) = 0) AS passed FROM b",
    dates=(),
)
def r10_gate(spark, sf_dir):
    return gates.baseline_gate(_baseline(spark, sf_dir))


@register(
    "r15_collection_gate",
    """WITH s AS (SELECT o_orderpriority AS priority, c_nationkey AS nation, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, o_orderstatus AS source, CAST(max(o_orderdate) AS DATE) AS coverage_end, CASE WHEN min(o_totalprice) < 2000 THEN 'degraded' ELSE 'ok' END AS status,
 count(*) > 2 AS noted FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
c AS (SELECT priority, nation, week, count(*) AS n, count(*) FILTER (source = 'P') AS strange, count(*) FILTER (status <> 'ok') AS ill, count(*) FILTER (noted) AS noted, count(*) FILTER (source = 'F' AND coverage_end BETWEEN week - 4 AND week) AS cur FROM s GROUP BY 1, 2, 3)
SELECT priority, nation, week, array_to_string(list_filter([CASE WHEN strange > 0 OR n <> 2 THEN 'sources' END, CASE WHEN ill > 0 THEN 'status' END, CASE WHEN noted > 0 THEN 'issues' END, CASE WHEN cur = 0 THEN 'market_week' END], lambda x: x IS NOT NULL), ';') AS reasons FROM c""",
)
def r15_gate(spark, sf_dir):
    """Orders of a nation, priority and week as a collection with the statuses as its sources; the market source covers its orders'
    days and is available at 16:00 in New York on the last of them, the cutoff that of the Friday."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders, day = read_table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("priority"), "nation", friday(day).alias("week"), F.col("o_orderstatus").alias("source")).agg(
        F.max(day).alias("coverage_end"), F.when(F.min("o_totalprice") < 2000, "degraded").otherwise("ok").alias("status"), F.when(F.count(F.lit(1)) > 2, F.array(F.lit("many"))).alias("issues")
    )
    four = lambda d: F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.col(d).cast("timestamp_ntz") + F.expr("interval 16 hours"))
    rows = rows.withColumns({"cutoff": four("week"), "available_at": four("coverage_end")})
    found = gates.collection_gate(rows, ["priority", "nation", "week"], ["F", "O"], "F")
    return found.withColumn("reasons", F.array_join("reasons", ";"))




@register(
    "r16_sanitized_records",
    "SELECT event_id, '[REDACTED]' AS token, user_id, '[REDACTED]' AS inner_password, event_type AS inner_kind, 'https://example.org/q?api_key=[REDACTED]&k=' || event_type AS url FROM events",
    dates=(),
)
def r16_sanitized(spark, sf_dir):
    """Request records made of the events: credentials as a field, a nested field, a map value and in an address."""
    url = F.concat(F.lit("https://example.org/q?api_key="), F.col("user_id").cast("string"), F.lit("&k="), F.col("event_type"))
    inner = F.struct(F.col("props").alias("password"), F.col("event_type").alias("kind"), F.array(F.create_map(F.lit("url"), url, F.lit("X-Refresh-Token"), F.col("props"))).alias("headers"))
    clean = gates.sanitize(read_table(spark, sf_dir, "events").select("event_id", F.col("props").alias("token"), "user_id", inner.alias("inner")))
    header = F.col("inner.headers")[0]
    kept = clean.filter(header["X-Refresh-Token"] == gates.REDACTED)
    return kept.select("event_id", "token", "user_id", F.col("inner.password").alias("inner_password"), F.col("inner.kind").alias("inner_kind"), header["url"].alias("url"))

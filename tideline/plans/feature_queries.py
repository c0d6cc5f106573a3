"""Feature queries on the driver tables, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideline.functions.numeric import min_periods, rounded
from tideline.operators import cross_section, features
from tideline.plans.registry import register
from tideline.session import read_table
from tideline.sources.panel import NATION_PANEL_SQL, ORDER_PANEL_SQL, friday, nation_panel, order_panel

BENCHMARK = "1-URGENT"
PAIRS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "5-LOW"), ("4-NOT SPECIFIED", "5-LOW"), ("1-URGENT", "absent")]
LAG = "OVER (PARTITION BY series_id ORDER BY week)"


def rolls(n: int, key: str = "series_id") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY week ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, least: int | None = None, key: str = "series_id") -> str:
    return f"CASE WHEN count({x}) {rolls(n, key)} >= {least or min_periods(n)} THEN {fn}({x}) {rolls(n, key)} END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) >= 1e-12 THEN ({a}) / ({b}) END"


def z(x: str, n: int) -> str:
    return div(f"{x} - ({roll('avg', x, n)})", f"({roll('stddev_pop', x, n)})")


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def sql(body: str, panel: str = ORDER_PANEL_SQL) -> str:
    return f"WITH {panel}{body}"


LNP = ", p AS (SELECT *, CASE WHEN price > 0 THEN ln(price) END AS lnp FROM panel)"
RET = LNP + f", r AS (SELECT *, lnp - lag(lnp, 1) {LAG} AS r FROM p)"


@register("f01_log_return", sql(LNP + " SELECT series_id, week, " + ", ".join(r6(f"lnp - lag(lnp, {k}) {LAG}", f"log_return_{k}w") for k in features.RETURN_LAGS) + " FROM p"))
def f01(spark, sf_dir):
    return rounded(features.log_returns(order_panel(spark, sf_dir)).drop("price", "volume", "lnp"))


@register(
    "f02_risk_adjusted_trend",
    sql(RET + " SELECT series_id, week, " + ", ".join(r6(div(f"lnp - lag(lnp, {k}) {LAG}", f"(({roll('stddev_pop', 'r', k)}) * {math.sqrt(k)!r})"), f"risk_adjusted_trend_{k}w") for k in (4, 13, 26, 52)) + " FROM r"),
)
def f02(spark, sf_dir):
    found = features.risk_adjusted_trend(order_panel(spark, sf_dir))
    return rounded(found.select("series_id", "week", *[f"risk_adjusted_trend_{k}w" for k in (4, 13, 26, 52)]))


@register("f03_realized_vol", sql(RET + " SELECT series_id, week, " + ", ".join(r6(f"({roll('stddev_pop', 'r', n)}) * {math.sqrt(52)!r}", f"realized_vol_{n}w") for n in (4, 13)) + " FROM r"))
def f03(spark, sf_dir):
    return rounded(features.realized_vol(order_panel(spark, sf_dir)).select("series_id", "week", "realized_vol_4w", "realized_vol_13w"))


@register(
    "f04_downside_vol",
    sql(RET + ", d AS (SELECT *, CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS q FROM r) SELECT series_id, week, " + ", ".join(r6(f"sqrt({roll('avg', 'q', n)}) * {math.sqrt(52)!r}", f"downside_vol_{n}w") for n in (4, 13)) + " FROM d"),
)
def f04(spark, sf_dir):
    return rounded(features.downside_vol(order_panel(spark, sf_dir)).select("series_id", "week", "downside_vol_4w", "downside_vol_13w"))


@register(
    "f05_drawdown",
    sql(" SELECT series_id, week, " + ", ".join(r6(f"price / ({roll('max', 'price', n)}) - 1", f"drawdown_{n}w") + ", " + r6(f"price / ({roll('min', 'price', n)}) - 1", f"recovery_from_low_{n}w") for n in (13, 52)) + " FROM panel"),
)
def f05(spark, sf_dir):
    return rounded(features.drawdown(order_panel(spark, sf_dir)).drop("price", "volume"))


@register("f06_missing_flag", sql(" SELECT series_id, week, CAST(price IS NULL AS DOUBLE) AS price__missing FROM panel"))
def f06(spark, sf_dir):
    return features.missing_flag(order_panel(spark, sf_dir)).select("series_id", "week", "price__missing")


@register(
    "f07_relative_return",
    sql(LNP + f", x AS (SELECT a.series_id, a.week, a.lnp - b.lnp AS e FROM p a LEFT JOIN p b ON b.series_id = '{BENCHMARK}' AND a.week = b.week WHERE a.series_id <> '{BENCHMARK}') SELECT series_id, week, " + ", ".join(r6(f"e - lag(e, {k}) {LAG}", f"relative_return_{k}w") for k in (4, 13, 26)) + " FROM x"),
)
def f07(spark, sf_dir):
    found = features.relative_return(order_panel(spark, sf_dir), BENCHMARK)
    return rounded(found.select("series_id", "week", *[f"relative_return_{k}w" for k in (4, 13, 26)]))


_PAIRS = ", ".join(f"('{a}/{b}', '{a}', '{b}')" for a, b in PAIRS)


@register(
    "f08_spread_pairs",
    sql(LNP + f", t(pair, a, b) AS (VALUES {_PAIRS}), x AS (SELECT pair, l.week, l.lnp - q.lnp AS e FROM t JOIN p l ON l.series_id = a JOIN p q ON q.series_id = b AND q.week = l.week) SELECT pair, week, " + ", ".join(r6(f"e - lag(e, {k}) OVER (PARTITION BY pair ORDER BY week)", f"spread_{k}w") for k in (4, 13)) + " FROM x"),
)
def f08(spark, sf_dir):
    return rounded(features.spread_pairs(order_panel(spark, sf_dir), PAIRS))


@register(
    "f09_f10_volume",
    sql(", v AS (SELECT *, CASE WHEN volume >= 0 THEN ln(1 + volume) END AS x FROM panel) SELECT series_id, week, " + ", ".join(r6(z("x", n), f"volume_z_{n}w") for n in (13, 52)) + ", " + r6(f"x - lag(x, 1) {LAG}", "volume_log_change_1w") + " FROM v"),
)
def f09(spark, sf_dir):
    return rounded(features.volume_z(order_panel(spark, sf_dir)).drop("price", "volume", "lnv"))


@register("f11_macro_changes", sql(" SELECT series_id, week, " + r6("price", "level") + ", " + ", ".join(r6(f"price - lag(price, {k}) {LAG}", f"change_{k}w") for k in (1, 4, 13)) + " FROM panel"))
def f11(spark, sf_dir):
    return rounded(features.macro_changes(order_panel(spark, sf_dir)).drop("price", "volume"))


@register("f12_macro_z", sql(" SELECT series_id, week, " + r6(z("price", 52), "z_52w") + " FROM panel"))
def f12(spark, sf_dir):
    return rounded(features.macro_z(order_panel(spark, sf_dir)).drop("price", "volume"))


@register("f13_change_z", sql(f", c AS (SELECT *, price - lag(price, 4) {LAG} AS x FROM panel) SELECT series_id, week, " + r6(z("x", 52), "change_4w_z_52w") + " FROM c"))
def f13(spark, sf_dir):
    return rounded(features.change_z(order_panel(spark, sf_dir)).select("series_id", "week", "change_4w_z_52w"))


_BARS = """ o AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, o_orderkey AS k, o_totalprice AS v, o_orderdate AS ts FROM orders),
bars AS (SELECT series_id, week, arg_min(v, (ts, k)) AS raw_open, max(v) AS raw_high, min(v) AS raw_low, arg_max(v, (ts, k)) AS raw_close,
                (max(v) + min(v)) / 2 AS adj_close, count(*) > 2 AS same_period FROM o GROUP BY 1, 2)"""


@register(
    "f14_adjusted_ohlc",
    f"WITH {_BARS}, a AS (SELECT *, CASE WHEN same_period AND raw_close > 0 AND adj_close > 0 THEN adj_close / raw_close END AS factor FROM bars), "
    "b AS (SELECT *, raw_open * factor AS adj_open, raw_high * factor AS adj_high, raw_low * factor AS adj_low FROM a) SELECT series_id, week, "
    + ", ".join(r6(x, x) for x in ("factor", "adj_open", "adj_high", "adj_low"))
    + ", "
    + r6("CASE WHEN adj_high > 0 THEN ln(adj_high) END - CASE WHEN adj_low > 0 THEN ln(adj_low) END", "log_range")
    + ", "
    + r6("CASE WHEN adj_high - adj_low >= 1e-12 THEN least(greatest((adj_close - adj_low) / (adj_high - adj_low), 0), 1) END", "close_location")
    + ", "
    + r6(f"ln(adj_open) - ln(lag(adj_close, 1) {LAG})", "log_gap")
    + " FROM b",
)
def f14(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    bars = orders.groupBy(F.col("o_orderpriority").alias("series_id"), friday(F.col("o_orderdate").cast("date")).alias("week")).agg(
        F.min_by("o_totalprice", at).alias("raw_open"), F.max("o_totalprice").alias("raw_high"), F.min("o_totalprice").alias("raw_low"),
        F.max_by("o_totalprice", at).alias("raw_close"), ((F.max("o_totalprice") + F.min("o_totalprice")) / 2).alias("adj_close"), (F.count(F.lit(1)) > 2).alias("same_period"),
    )
    keep = ["series_id", "week", "factor", "adj_open", "adj_high", "adj_low", "log_range", "close_location", "log_gap"]
    return rounded(features.adjusted_ohlc(bars).select(keep))


@register(
    "f15_breadth_acceleration",
    sql(RET + ", s AS (SELECT week, CASE WHEN count(r) >= 2 THEN avg(CAST(r > 0 AS DOUBLE)) END AS x FROM r GROUP BY week) SELECT week, " + r6("x", "positive_share_1w") + ", " + ", ".join(r6(f"x - lag(x, {k}) OVER (ORDER BY week)", f"breadth_change_{k}w") for k in (1, 4)) + " FROM s"),
)
def f15(spark, sf_dir):
    return rounded(cross_section.breadth_acceleration(order_panel(spark, sf_dir)))


_CREDIT = """ c AS (SELECT 'all' AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) + 4 AS week, round(sum(o_totalprice), 2) AS total_loans,
 round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS business_loans, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS deposits,
 round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS borrowings FROM orders GROUP BY 2)"""


@register(
    "f16_bank_credit",
    f"WITH {_CREDIT} SELECT week, "
    + ", ".join(r6(f"ln({x}) - lag(ln({x}), {k}) OVER (ORDER BY week)", f"{n}_growth_{k}w") for n, x in (("total", "total_loans"), ("business", "business_loans")) for k in (4, 13))
    + ", " + r6("business_loans / total_loans", "business_share") + ", " + r6("deposits / total_loans", "deposit_ratio") + ", " + r6("borrowings / 1000 / total_loans", "borrowing_ratio")
    + ", (CAST(total_loans IS NOT NULL AS INT) + CAST(business_loans IS NOT NULL AS INT) + CAST(deposits IS NOT NULL AS INT) + CAST(borrowings IS NOT NULL AS INT)) / 4.0::DOUBLE AS coverage FROM c",
)
def f16(spark, sf_dir):
    total = lambda c: F.round(F.sum(c), 2)
    when = lambda test: F.when(test, F.col("o_totalprice"))
    weekly = read_table(spark, sf_dir, "orders").groupBy(friday(F.col("o_orderdate").cast("date")).alias("week")).agg(
        total("o_totalprice").alias("total_loans"), total(when(F.col("o_orderpriority") == "1-URGENT")).alias("business_loans"),
        total(when(F.col("o_orderstatus") == "O")).alias("deposits"), total(when(F.col("o_orderstatus") == "F")).alias("borrowings"),
    )
    found = features.bank_credit(weekly.withColumn("series_id", F.lit("all")))
    return rounded(found.drop("series_id", "total_loans", "business_loans", "deposits", "borrowings", "ln_total", "ln_business"))


_RELEASES = """ rel AS (SELECT series_id, week, price AS value, CAST(week - CAST(extract(day FROM week) AS INT) % 14 AS DATE) AS observed_period FROM panel WHERE price IS NOT NULL),
m AS (SELECT *, lag(value) OVER o AS pv, lag(observed_period) OVER o AS pp, row_number() OVER o AS i FROM rel WINDOW o AS (PARTITION BY series_id ORDER BY week)),
k AS (SELECT *, coalesce(observed_period <> pp, false) AS pc, coalesce(observed_period = pp AND value <> pv, false) AS re, value - pv AS d FROM m),
e AS (SELECT *, pc OR re AS ev FROM k),
h AS (SELECT a.series_id, a.week, b.d, row_number() OVER (PARTITION BY a.series_id, a.week ORDER BY b.i DESC) AS k
      FROM e a JOIN e b ON a.series_id = b.series_id AND b.i < a.i AND b.ev AND b.d IS NOT NULL),
c AS (SELECT series_id, week, count(*) AS n FROM h GROUP BY 1, 2),
x AS (SELECT series_id, week, median(d) AS expected FROM h WHERE k <= 12 GROUP BY 1, 2 HAVING count(*) >= 4),
s AS (SELECT h.series_id, h.week, 1.4826 * median(abs(d - expected)) AS scale FROM h JOIN x USING (series_id, week) WHERE k <= 12 GROUP BY 1, 2)"""


@register(
    "f17_release_innovation",
    sql(
        f", {_RELEASES} SELECT e.series_id, e.week, CAST(ev AS DOUBLE) AS event, CAST(pc AS DOUBLE) AS period_change, CAST(re AS DOUBLE) AS revision_event, "
        + ", ".join(
            r6(f"CASE WHEN ev THEN {v} ELSE 0 END", n)
            for n, v in (("delta", "d"), ("expected", "expected"), ("scale", "scale"), ("standardized", "CASE WHEN scale > 0 THEN (d - expected) / scale END"))
        )
        + ", " + r6("least(coalesce(n, 0) / 4.0, 1.0)::DOUBLE", "coverage")
        + ", least(coalesce(n, 0), 12) AS prior_event_count"
        + " FROM e LEFT JOIN c USING (series_id, week) LEFT JOIN x USING (series_id, week) LEFT JOIN s USING (series_id, week)"
    ),
)
def f17(spark, sf_dir):
    panel = order_panel(spark, sf_dir).filter("price IS NOT NULL")
    releases = panel.select("series_id", "week", F.col("price").alias("value"), F.date_sub("week", F.dayofmonth("week") % 14).alias("observed_period"))
    return rounded(features.release_innovation(releases))


@register(
    "x01_positive_share",
    sql(LNP + f", r AS (SELECT week, lnp - lag(lnp, 1) {LAG} AS a, lnp - lag(lnp, 4) {LAG} AS b FROM p) SELECT week, " + ", ".join(r6(f"CASE WHEN count({x}) >= 2 THEN avg(CAST({x} > 0 AS DOUBLE)) END", f"positive_share_{k}w") for x, k in (("a", 1), ("b", 4))) + " FROM r GROUP BY week"),
)
def x01(spark, sf_dir):
    return rounded(cross_section.positive_share(order_panel(spark, sf_dir)))


@register(
    "x02_above_mean_share",
    sql(LNP + ", m AS (SELECT week, " + ", ".join(f"CAST(lnp > ({roll('avg', 'lnp', n)}) AS DOUBLE) AS a{n}" for n in (13, 26)) + " FROM p) SELECT week, " + ", ".join(r6(f"CASE WHEN count(a{n}) >= 2 THEN avg(a{n}) END", f"above_mean_share_{n}w") for n in (13, 26)) + " FROM m GROUP BY week"),
)
def x02(spark, sf_dir):
    return rounded(cross_section.above_mean_share(order_panel(spark, sf_dir)))


@register("x03_x04_dispersion", sql(RET + " SELECT week, " + r6("CASE WHEN count(r) >= 2 THEN stddev_pop(r) END", "dispersion") + ", " + r6("CASE WHEN count(r) >= 2 THEN abs(avg(sign(r))) END", "synchronisation") + " FROM r GROUP BY week"))
def x03(spark, sf_dir):
    return rounded(cross_section.dispersion(order_panel(spark, sf_dir)))


def _corr(n: int) -> str:
    w = rolls(n, "pair")
    root = f"sqrt(var_pop(x) {w} * var_pop(y) {w})"
    return f"CASE WHEN count(x) {w} >= {min_periods(n)} AND {root} >= 1e-12 THEN least(greatest((avg(x * y) {w} - avg(x) {w} * avg(y) {w}) / {root}, -1), 1) END AS c{n}"


@register(
    "x05_pairwise_correlation",
    sql(RET + ", q AS (SELECT a.series_id || '|' || b.series_id AS pair, a.week, CASE WHEN b.r IS NOT NULL THEN a.r END AS x, CASE WHEN a.r IS NOT NULL THEN b.r END AS y FROM r a JOIN r b ON a.week = b.week AND a.series_id < b.series_id), c AS (SELECT week, " + ", ".join(map(_corr, (13, 26))) + " FROM q) SELECT week, " + ", ".join(r6(f"avg(c{n})", f"average_correlation_{n}w") for n in (13, 26)) + " FROM c GROUP BY week"),
)
def x05(spark, sf_dir):
    return rounded(cross_section.pairwise_correlation(order_panel(spark, sf_dir)))


@register(
    "x06_volume_breadth",
    sql(RET + f", v AS (SELECT week, r, volume - lag(volume, 1) {LAG} AS dv FROM r), k AS (SELECT *, CASE WHEN dv IS NOT NULL AND r IS NOT NULL THEN CASE WHEN dv > 0 THEN sign(r) ELSE 0 END END AS c FROM v) SELECT week, " + r6("CASE WHEN count(dv) >= 2 THEN avg(CAST(dv > 0 AS DOUBLE)) END", "rising_volume_share") + ", " + r6("CASE WHEN count(c) >= 2 THEN avg(c) END", "net_confirmation") + " FROM k GROUP BY week"),
)
def x06(spark, sf_dir):
    return rounded(cross_section.volume_breadth(order_panel(spark, sf_dir)))


@register(
    "x07_group_block",
    sql(
        RET + ", f AS (SELECT *, median(r) OVER g AS med, sum(CASE WHEN r > 0 THEN r END) OVER g AS tot FROM r WINDOW g AS (PARTITION BY group_id, week)) SELECT group_id, week, "
        + r6("CASE WHEN count(r) >= 2 THEN avg(CAST(r > 0 AS DOUBLE)) END", "positive_share") + ", " + r6("count(r) / count(*)", "coverage") + ", "
        + r6("CASE WHEN count(r) >= 2 THEN avg(CAST(r < 0 AS DOUBLE)) END", "downside_share") + ", " + r6("CASE WHEN count(r) >= 2 THEN median(r) END", "median_return") + ", "
        + r6("CASE WHEN count(r) >= 2 THEN median(abs(r - med)) END", "mad") + ", " + r6("CASE WHEN count(r) >= 2 THEN sum(CASE WHEN r IS NOT NULL AND abs(tot) >= 1e-12 THEN pow(greatest(r, 0) / tot, 2) END) END", "leader_hhi") + " FROM f GROUP BY 1, 2",
        NATION_PANEL_SQL,
    ),
)
def x07(spark, sf_dir):
    return rounded(cross_section.group_block(nation_panel(spark, sf_dir)))


MATURITIES = {"1-URGENT": 3.0, "2-HIGH": 12.0, "3-MEDIUM": 36.0, "4-NOT SPECIFIED": 84.0, "5-LOW": 120.0}
_LOADS = ", ".join(f"('{s}', {-math.expm1(-0.0609 * t) / (0.0609 * t)!r}e0, {-math.expm1(-0.0609 * t) / (0.0609 * t) - math.exp(-0.0609 * t)!r}e0)" for s, t in MATURITIES.items())


def _det(c: list[list[str]]) -> str:
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = c
    return f"({a1} * ({b2} * {c3} - {b3} * {c2}) - {a2} * ({b1} * {c3} - {b3} * {c1}) + {a3} * ({b1} * {c2} - {b2} * {c1}))"


_M, _Y = [["n", "sb", "sc"], ["sb", "bb", "bc"], ["sc", "bc", "cc"]], ["sy", "by_", "cy"]


@register(
    "x08_nelson_siegel",
    sql(f", l(series_id, b, c) AS (VALUES {_LOADS}), m AS (SELECT week, count(*) AS n, sum(b) AS sb, sum(c) AS sc, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(price) AS sy, sum(b * price) AS by_, sum(c * price) AS cy FROM panel JOIN l USING (series_id) WHERE price IS NOT NULL GROUP BY week) SELECT week, " + ", ".join("round(" + f"CASE WHEN n >= 4 THEN {_det([[_Y[i] if j == k else _M[i][j] for j in range(3)] for i in range(3)])} / {_det(_M)} END" + f", 2) + 0.0 AS {name}" for k, name in enumerate(("level", "slope", "curvature"))) + ", n / 5 AS coverage FROM m"),
)
def x08(spark, sf_dir):
    return rounded(cross_section.nelson_siegel(order_panel(spark, sf_dir), MATURITIES), places=2)


@register(
    "x09_worst_health",
    "SELECT CAST(o_orderdate AS DATE) AS key, CASE max(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END) WHEN 0 THEN 'O' WHEN 1 THEN 'P' WHEN 2 THEN 'F' END AS status FROM orders GROUP BY 1",
    dates=("key",),
)
def x09(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("key"), F.col("o_orderstatus").alias("status"))
    return cross_section.worst_health(rows, ["O", "P", "F"])


WEIGHTS = {"1-URGENT": 1.0, "2-HIGH": 0.5, "5-LOW": -1.0}


@register(
    "x10_factor_scores",
    sql(", zz AS (SELECT series_id, week, " + z("price", 52) + " AS z FROM panel), t(series_id, w) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items()) + ") SELECT week, " + r6("least(greatest(tanh(coalesce(avg(z * w), 0) / 2), -1), 1)", "score") + " FROM zz JOIN t USING (series_id) GROUP BY week"),
)
def x10(spark, sf_dir):
    found = features.macro_z(order_panel(spark, sf_dir)).select("week", F.col("series_id").alias("name"), F.col("z_52w").alias("z"))
    return rounded(cross_section.factor_scores(found, WEIGHTS))


@register(
    "x11_pivot",
    sql(" SELECT week, " + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN price END) AS \"{s}\"" for s in MATURITIES) + " FROM panel GROUP BY week"),
)
def x11(spark, sf_dir):
    return order_panel(spark, sf_dir).groupBy("week").pivot("series_id", list(MATURITIES)).agg(F.first("price", ignorenulls=True))

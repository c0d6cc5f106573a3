"""One-sided weekly features over long panels (series_id, week, price, volume).

Every operator adds columns and keeps the rows; all windows of a panel share one partitioning and order, so Spark
computes them in one shuffle and sort. Panels must be dense: a missing week is a row with NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import TINY, clip, lag, positive_log, rolling, rolling_z, safe_divide

RETURN_LAGS = (1, 4, 13, 26, 52)
VOL_WINDOWS = (4, 13)
DRAWDOWN_WINDOWS = (13, 52)
Z_WINDOW = 52


def log_returns(panel: DataFrame, lags=RETURN_LAGS) -> DataFrame:
    """log_return_{k}w: change of the log price over k rows."""
    logged = panel.withColumn("lnp", positive_log(F.col("price")))
    return logged.withColumns({f"log_return_{k}w": F.col("lnp") - lag("lnp", k) for k in lags})


def risk_adjusted_trend(panel: DataFrame, lags=(4, 13, 26, 52)) -> DataFrame:
    """Return over k weeks in units of its trailing volatility."""
    r = F.col("log_return_1w")
    return log_returns(panel).withColumns(
        {f"risk_adjusted_trend_{k}w": safe_divide(F.col(f"log_return_{k}w"), rolling(F.stddev_pop, r, k) * math.sqrt(k)) for k in lags}
    )


def realized_vol(panel: DataFrame, windows=VOL_WINDOWS) -> DataFrame:
    r = F.col("log_return_1w")
    return log_returns(panel, (1,)).withColumns({f"realized_vol_{n}w": rolling(F.stddev_pop, r, n) * math.sqrt(52) for n in windows})


def downside_vol(panel: DataFrame, windows=VOL_WINDOWS) -> DataFrame:
    """Root mean square of the negative returns, annualised; a missing return stays missing."""
    r = F.col("log_return_1w")
    squared = F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), 2))
    return log_returns(panel, (1,)).withColumns({f"downside_vol_{n}w": F.sqrt(rolling(F.avg, squared, n)) * math.sqrt(52) for n in windows})


def drawdown(panel: DataFrame, windows=DRAWDOWN_WINDOWS) -> DataFrame:
    """Distance from the highest and the lowest price of the window."""
    p, out = F.col("price"), {}
    for n in windows:
        out[f"drawdown_{n}w"] = safe_divide(p, rolling(F.max, p, n)) - 1
        out[f"recovery_from_low_{n}w"] = safe_divide(p, rolling(F.min, p, n)) - 1
    return panel.withColumns(out)


def missing_flag(panel: DataFrame) -> DataFrame:
    return panel.withColumn("price__missing", F.col("price").isNull().cast("double"))


def relative_return(panel: DataFrame, benchmark: str, lags=(4, 13, 26)) -> DataFrame:
    """Return over that of the benchmark series; the benchmark's weeks are joined on week, one row each."""
    logged = panel.withColumn("lnp", positive_log(F.col("price")))
    base = logged.filter(F.col("series_id") == benchmark).select("week", F.col("lnp").alias("lnb"))
    joined = logged.filter(F.col("series_id") != benchmark).join(base, "week", "left").withColumn("excess", F.col("lnp") - F.col("lnb"))
    return joined.withColumns({f"relative_return_{k}w": F.col("excess") - lag("excess", k) for k in lags})


def spread_pairs(panel: DataFrame, pairs: list[tuple[str, str]], lags=(4, 13)) -> DataFrame:
    """Change of the log ratio of named pairs; a pair whose legs are not both in the panel is left out."""
    logged = panel.select("series_id", "week", positive_log(F.col("price")).alias("lnp"))
    table = panel.sparkSession.createDataFrame([(f"{a}/{b}", a, b) for a, b in pairs], "pair string, left_id string, right_id string")
    left = logged.select(F.col("series_id").alias("left_id"), "week", F.col("lnp").alias("lnl"))
    right = logged.select(F.col("series_id").alias("right_id"), "week", F.col("lnp").alias("lnr"))
    ratio = table.join(left, "left_id").join(right, ["right_id", "week"]).withColumn("ratio", F.col("lnl") - F.col("lnr"))
    return ratio.withColumns({f"spread_{k}w": F.col("ratio") - lag("ratio", k, "pair") for k in lags}).select("pair", "week", *[f"spread_{k}w" for k in lags])


def volume_z(panel: DataFrame, windows=(13, 52)) -> DataFrame:
    """z-score of log volume, and its change over one week."""
    v = F.col("lnv")
    logged = panel.withColumn("lnv", F.when(F.col("volume") >= 0, F.log1p("volume")))
    return logged.withColumns({f"volume_z_{n}w": rolling_z(v, n) for n in windows} | {"volume_log_change_1w": v - lag("lnv", 1)})


def macro_changes(panel: DataFrame, lags=(1, 4, 13)) -> DataFrame:
    return panel.withColumns({"level": F.col("price")} | {f"change_{k}w": F.col("price") - lag("price", k) for k in lags})


def macro_z(panel: DataFrame, n: int = Z_WINDOW) -> DataFrame:
    return panel.withColumn(f"z_{n}w", rolling_z(F.col("price"), n))


def change_z(panel: DataFrame, k: int = 4, n: int = Z_WINDOW) -> DataFrame:
    """z-score of the change over k weeks: a window over a window."""
    return macro_changes(panel, (k,)).withColumn(f"change_{k}w_z_{n}w", rolling_z(F.col(f"change_{k}w"), n))


def adjusted_ohlc(bars: DataFrame) -> DataFrame:
    """Split-adjusted bars of (series_id, week, raw_open, raw_high, raw_low, raw_close, adj_close, same_period).

    The factor is known only if all five fields come from one observed period and both closes are positive; the gap is
    against the adjusted close of the row before.
    """
    usable = F.col("same_period") & (F.col("raw_close") > 0) & (F.col("adj_close") > 0)
    scaled = bars.withColumn("factor", F.when(usable, F.col("adj_close") / F.col("raw_close")))
    scaled = scaled.withColumns({f"adj_{x}": F.col(f"raw_{x}") * F.col("factor") for x in ("open", "high", "low")})
    span = F.col("adj_high") - F.col("adj_low")
    return scaled.withColumns(
        {
            "log_range": positive_log(F.col("adj_high")) - positive_log(F.col("adj_low")),
            "close_location": clip(safe_divide(F.col("adj_close") - F.col("adj_low"), span), 0.0, 1.0),
            "log_gap": positive_log(F.col("adj_open")) - positive_log(lag("adj_close", 1)),
        }
    )


def bank_credit(frame: DataFrame) -> DataFrame:
    """Growth and ratios over (series_id, week, total_loans, business_loans, deposits, borrowings in thousands).

    All ratios are to total loans, and NULL unless these are above zero.
    """
    inputs = ("total_loans", "business_loans", "deposits", "borrowings")
    total, business = positive_log(F.col("total_loans")), positive_log(F.col("business_loans"))
    logged = frame.withColumns({"ln_total": total, "ln_business": business})
    lent = F.when(F.col("total_loans") > 0, F.col("total_loans"))
    growth = {f"{x}_growth_{k}w": F.col(f"ln_{x}") - lag(f"ln_{x}", k) for x in ("total", "business") for k in (4, 13)}
    return logged.withColumns(
        growth
        | {
            "business_share": F.col("business_loans") / lent,
            "deposit_ratio": F.col("deposits") / lent,
            "borrowing_ratio": F.col("borrowings") / 1000 / lent,
            "coverage": sum(F.col(x).isNotNull().cast("double") for x in inputs) / len(inputs),
        }
    )


def release_innovation(frame: DataFrame, window: int = 12, least: int = 4) -> DataFrame:
    """Surprise of each release of (series_id, week, value, observed_period).

    An event is a new period, or a new value of the same period (a revision). The expected change is the median of the
    last ``window`` event changes before it, the scale 1.4826 times their median absolute deviation; both need ``least``
    of them. Where there is no event the signals are 0; prior_event_count is at most ``window``.

    Events are numbered, so a range frame over twice their number holds the last ones and nothing older.
    """
    order = Window.partitionBy("series_id").orderBy("week")
    before, period = F.lag("value").over(order), F.lag("observed_period").over(order)
    new_period = F.coalesce(F.col("observed_period") != period, F.lit(False))
    revised = F.coalesce((F.col("observed_period") == period) & (F.col("value") != before), F.lit(False))
    marked = frame.withColumns({"period_change": new_period, "revision_event": revised, "delta": F.col("value") - before})
    marked = marked.withColumn("is_event", F.col("period_change") | F.col("revision_event"))
    marked = marked.withColumn("known", F.when(F.col("is_event"), F.col("delta")))
    number = F.count("known").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("place", 2 * number + F.col("known").isNull().cast("int"))
    recent = Window.partitionBy("series_id").orderBy("place").rangeBetween(-2 * window, -1)
    marked = marked.withColumn("past", F.collect_list("known").over(recent))
    marked = marked.withColumn("prior_event_count", F.size("past").cast("long"))
    marked = marked.withColumn("recent", F.when(F.col("is_event") & (F.size("past") >= least), F.array_sort("past")))
    middle = lambda a: (F.get(a, ((F.size(a) - 1) / 2).cast("int")) + F.get(a, (F.size(a) / 2).cast("int"))) / 2
    marked = marked.withColumn("expected", middle(F.col("recent")))
    marked = marked.withColumn("spread", F.array_sort(F.transform("recent", lambda x: F.abs(x - F.col("expected")))))
    marked = marked.withColumn("scale", F.lit(1.4826) * middle(F.col("spread")))
    zero_unless = lambda x: F.when(F.col("is_event"), x).otherwise(F.lit(0.0))
    return marked.select(
        "series_id", "week", *[F.col(x).cast("double").alias(n) for x, n in (("is_event", "event"), ("period_change", "period_change"), ("revision_event", "revision_event"))],
        zero_unless(F.col("delta")).alias("delta"), zero_unless(F.col("expected")).alias("expected"), zero_unless(F.col("scale")).alias("scale"),
        zero_unless(F.when(F.col("scale") > 0, (F.col("delta") - F.col("expected")) / F.col("scale"))).alias("standardized"),
        F.least(F.col("prior_event_count") / float(least), F.lit(1.0)).alias("coverage"), "prior_event_count",
    )


def state_durations(states: DataFrame) -> DataFrame:
    """Run length of the current state of (series_id, week, state): gaps and islands."""
    order = Window.partitionBy("series_id").orderBy("week")
    starts = F.coalesce((F.col("state") != F.lag("state").over(order)).cast("int"), F.lit(1))
    islands = states.withColumn("run", F.sum(starts).over(order))
    return islands.withColumn("duration", F.row_number().over(Window.partitionBy("series_id", "run").orderBy("week")).cast("long")).drop("run")


def transition_path(scored: DataFrame) -> DataFrame:
    """Path of a risk score towards its thresholds, from (series_id, week, risk_score, state, lower, upper)."""
    score, width = F.col("risk_score"), F.greatest(F.col("upper") - F.col("lower"), F.lit(1e-6))
    first = scored.withColumns({f"score_change_{k}w": score - lag("risk_score", k) for k in (1, 2, 4)})
    first = first.withColumns({"to_lower": (score - F.col("lower")) / width, "to_upper": (F.col("upper") - score) / width})
    near = F.least(F.abs("to_lower"), F.abs("to_upper"))
    # risk_on: above the upper threshold is positive; risk_off: below the lower one; transition: between the two
    inside = F.when(score.isNotNull(), F.least("to_lower", "to_upper"))
    own = F.when(F.col("state") == "risk_on", -F.col("to_upper")).when(F.col("state") == "transition", inside).when(F.col("state") == "risk_off", -F.col("to_lower"))
    return first.withColumns({"score_acceleration": F.col("score_change_1w") - lag("score_change_1w", 1), "nearest_boundary": near, "state_distance": own})

"""Whole feature tables composed from the single operators: the weekly matrix, the transition features, the market context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import lag, positive_log
from tideline.operators import cross_section, features

RELATIVE_LAGS = (4, 13, 26)
STATE, DURATION = "state", "duration"


def weekly_matrix(panel: DataFrame, benchmark: str, outside: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, week) with the price and volume features of the series, those against ``benchmark`` and the internals of its week.

    Series in ``outside`` have features of their own but are no part of the internals. Rows stay as they are; every value looks
    back only, and missing ones stay missing. The benchmark's rows have no relative return. All windows of a series share one
    shuffle and sort; the benchmark and the internals are one row a week, joined on week.
    """
    base = panel.filter(F.col("series_id") == benchmark).select("week", positive_log(F.col("price")).alias("_benchmark"))
    own = panel.select("series_id", "week", "price", "volume").join(base, "week", "left")
    for add in (features.risk_adjusted_trend, features.realized_vol, features.downside_vol, features.drawdown, features.missing_flag, features.volume_z):
        own = add(own)
    own = own.withColumn("_excess", F.when(F.col("series_id") != benchmark, F.col("lnp") - F.col("_benchmark")))
    own = own.withColumns({f"relative_return_{k}w": F.col("_excess") - lag("_excess", k) for k in RELATIVE_LAGS}).drop("_excess", "_benchmark", "lnp", "lnv")
    inside = panel.filter(~F.col("series_id").isin(*outside)) if outside else panel
    internals = [
        cross_section.positive_share(inside), cross_section.above_mean_share(inside), cross_section.dispersion(inside), cross_section.pairwise_correlation(inside),
        cross_section.volume_breadth(inside), cross_section.breadth_acceleration(inside).drop("positive_share_1w"),
    ]
    return own.join(reduce(lambda a, b: a.join(b, "week", "full"), internals), "week", "left")


def transition_features(frame: DataFrame, overwrite: bool = False) -> DataFrame:
    """``frame`` (series_id, week, state and optionally risk_score, lower, upper) with duration, path and boundary features.

    Columns that are already there stay unless ``overwrite``: a slice that does not start at the beginning of its series brings
    its own durations, which must be whole numbers from 1 on, else the job fails. Without risk_score there is no path, without
    thresholds no boundary; one threshold alone, or columns that are missing, are refused. Rows whose thresholds do not rise
    fail the job.
    """
    have = set(frame.columns)
    if not {"series_id", "week", STATE} <= have:
        raise ValueError("transition features need series_id, week and state")
    if ("lower" in have) != ("upper" in have):
        raise ValueError("lower and upper come together")
    keep = [c for c in frame.columns if not (overwrite and c == DURATION)]
    if DURATION in keep:
        whole = F.coalesce((F.col(DURATION) >= 1) & (F.col(DURATION) == F.round(DURATION)), F.lit(False))
        out = frame.withColumn(DURATION, F.when(whole, F.col(DURATION)).otherwise(F.raise_error(F.lit("durations must be whole numbers from 1 on")).cast("double")))
    else:
        out = features.state_durations(frame.select(keep))
    if "risk_score" not in have:
        return out
    bounded = "lower" in have
    if bounded:
        rising = F.when(F.col("lower") < F.col("upper"), F.col("lower")).otherwise(F.raise_error(F.lit("thresholds must rise")).cast("double"))
        path_of = frame.select("series_id", "week", STATE, "risk_score", rising.alias("lower"), "upper")
    else:
        path_of = frame.select("series_id", "week", STATE, "risk_score", F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"))
    made = ["score_change_1w", "score_change_2w", "score_change_4w", "score_acceleration"] + (["to_lower", "to_upper", "nearest_boundary", "state_distance"] if bounded else [])
    new = [c for c in made if overwrite or c not in have]
    path = features.transition_path(path_of).select("series_id", "week", *new)
    return out.drop(*new).join(path, ["series_id", "week"], "left")


def market_context(panel: DataFrame, benchmark: str, others: list[str], at: str | None = None) -> DataFrame:
    """One row: the benchmark's last week no later than ``at`` with price, one-week return, 13-week volatilities, drawdown over 52
    weeks, and the 13-week return of each of ``others`` over it (relative_{name}); a series that is not there has NULL.

    Nothing after ``at`` is read; a benchmark without rows gives none.
    """
    known = panel if at is None else panel.filter(F.col("week") <= F.lit(at).cast("date"))
    own = known.filter(F.col("series_id") == benchmark).select("series_id", "week", "price")
    own = features.drawdown(features.downside_vol(features.realized_vol(own), (13,)), (52,))
    last = own.withColumn("_last", F.max("week").over(Window.partitionBy("series_id"))).filter("week = _last")
    some = known.filter(F.col("series_id").isin(benchmark, *others)).select("series_id", "week", "price")
    relative = features.relative_return(some, benchmark, (13,)).groupBy("week").agg(
        *[F.max(F.when(F.col("series_id") == o, F.col("relative_return_13w"))).alias(f"relative_{o}") for o in others]
    )
    return last.select("week", "price", "log_return_1w", "realized_vol_13w", "downside_vol_13w", "drawdown_52w").join(relative, "week", "left")

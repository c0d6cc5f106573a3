"""Cross-sectional operators: one row per week from many series. Aggregates combine before the shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import clip, lag, min_periods, positive_log, rolling, rows_back, safe_divide
from tideline.operators.features import log_returns
from tideline.operators.pit import severity

DECAY = 0.0609


def gated(value: Column, counted: Column, least: int = 2) -> Column:
    return F.when(F.count(counted) >= least, value)


def positive_share(panel: DataFrame, lags=(1, 4)) -> DataFrame:
    r = log_returns(panel, lags)
    return r.groupBy("week").agg(
        *[gated(F.avg((F.col(f"log_return_{k}w") > 0).cast("double")), F.col(f"log_return_{k}w")).alias(f"positive_share_{k}w") for k in lags]
    )


def above_mean_share(panel: DataFrame, windows=(13, 26)) -> DataFrame:
    p = panel.withColumn("lnp", positive_log(F.col("price")))
    p = p.withColumns({f"above_{n}": (F.col("lnp") > rolling(F.avg, F.col("lnp"), n)).cast("double") for n in windows})
    return p.groupBy("week").agg(*[gated(F.avg(f"above_{n}"), F.col(f"above_{n}")).alias(f"above_mean_share_{n}w") for n in windows])


def dispersion(panel: DataFrame) -> DataFrame:
    r = F.col("log_return_1w")
    return log_returns(panel, (1,)).groupBy("week").agg(gated(F.stddev_pop(r), r).alias("dispersion"), gated(F.abs(F.avg(F.signum(r))), r).alias("synchronisation"))


def pairwise_correlation(panel: DataFrame, windows=(13, 26)) -> DataFrame:
    """Mean rolling correlation over all pairs of series, from moments of the weeks that both have.

    The pairs come from a join on week; their number is that of configured series, not of rows.
    """
    r = log_returns(panel, (1,)).select("series_id", "week", F.col("log_return_1w").alias("r"))
    other = r.select(F.col("series_id").alias("other_id"), "week", F.col("r").alias("s"))
    pairs = r.join(other.withColumnRenamed("week", "_week"), (F.col("week") == F.col("_week")) & (F.col("series_id") < F.col("other_id"))).drop("_week").withColumn("pair", F.concat_ws("|", "series_id", "other_id"))
    both = F.col("r").isNotNull() & F.col("s").isNotNull()
    pairs = pairs.withColumns({"x": F.when(both, F.col("r")), "y": F.when(both, F.col("s"))}).withColumns({"xy": F.col("x") * F.col("y")})
    out = {}
    for n in windows:
        w = rows_back(n, "pair")
        spread = F.sqrt(F.var_pop("x").over(w) * F.var_pop("y").over(w))
        value = safe_divide(F.avg("xy").over(w) - F.avg("x").over(w) * F.avg("y").over(w), spread)
        out[f"corr_{n}"] = F.when(F.count("x").over(w) >= min_periods(n), clip(value, -1.0, 1.0))
    return pairs.withColumns(out).groupBy("week").agg(*[F.avg(f"corr_{n}").alias(f"average_correlation_{n}w") for n in windows])


def volume_breadth(panel: DataFrame) -> DataFrame:
    """Share of series with rising volume, and mean sign of the return where volume rises (0 where it does not)."""
    r = log_returns(panel, (1,)).withColumn("dv", F.col("volume") - lag("volume", 1))
    confirm = F.when(F.col("dv").isNotNull() & F.col("log_return_1w").isNotNull(), F.when(F.col("dv") > 0, F.signum("log_return_1w")).otherwise(F.lit(0.0)))
    r = r.withColumn("confirm", confirm)
    return r.groupBy("week").agg(
        gated(F.avg((F.col("dv") > 0).cast("double")), F.col("dv")).alias("rising_volume_share"), gated(F.avg("confirm"), F.col("confirm")).alias("net_confirmation")
    )


def group_block(panel: DataFrame) -> DataFrame:
    """Per group and week of (series_id, group_id, week, price): breadth, coverage, median, MAD and leader concentration."""
    r = log_returns(panel, (1,)).withColumn("r", F.col("log_return_1w"))
    up = F.when(F.col("r") > 0, F.col("r"))
    first = r.groupBy("group_id", "week").agg(F.median("r").alias("_median"), F.sum(up).alias("_total"))
    joined = r.join(first, ["group_id", "week"])
    share = safe_divide(F.greatest(F.col("r"), F.lit(0.0)), F.col("_total"))
    return joined.groupBy("group_id", "week").agg(
        gated(F.avg((F.col("r") > 0).cast("double")), F.col("r")).alias("positive_share"),
        (F.count("r") / F.count(F.lit(1))).alias("coverage"),
        gated(F.avg((F.col("r") < 0).cast("double")), F.col("r")).alias("downside_share"),
        gated(F.first("_median"), F.col("r")).alias("median_return"),
        gated(F.median(F.abs(F.col("r") - F.col("_median"))), F.col("r")).alias("mad"),
        gated(F.sum(F.when(F.col("r").isNotNull(), share * share)), F.col("r")).alias("leader_hhi"),
    )


def breadth_acceleration(panel: DataFrame) -> DataFrame:
    share = positive_share(panel, (1,)).withColumn("series_id", F.lit("all"))
    return share.withColumns({f"breadth_change_{k}w": F.col("positive_share_1w") - lag("positive_share_1w", k) for k in (1, 4)}).drop("series_id")


def nelson_siegel(curve: DataFrame, maturities: dict[str, float], decay: float = DECAY, least: int = 4) -> DataFrame:
    """Level, slope and curvature per week of (series_id, week, price): least squares on fixed loadings.

    Normal equations are sums per week; the 3x3 system is solved by Cramer's rule in the same projection.
    """
    slope = lambda t: -math.expm1(-decay * t) / (decay * t)
    rows = [(s, slope(t), slope(t) - math.exp(-decay * t)) for s, t in maturities.items()]
    loads = curve.sparkSession.createDataFrame(rows, "series_id string, b double, c double")
    y, b, c = F.col("price"), F.col("b"), F.col("c")
    sums = curve.filter(y.isNotNull()).join(F.broadcast(loads), "series_id").groupBy("week").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(b).alias("sb"), F.sum(c).alias("sc"), F.sum(b * b).alias("bb"), F.sum(b * c).alias("bc"), F.sum(c * c).alias("cc"),
        F.sum(y).alias("sy"), F.sum(b * y).alias("by"), F.sum(c * y).alias("cy"),
    )
    m = {k: F.col(k) for k in ("n", "sb", "sc", "bb", "bc", "cc", "sy", "by", "cy")}

    def det(rows_: list[list[Column]]) -> Column:
        (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = rows_
        return a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)

    columns = [[m["n"], m["sb"], m["sc"]], [m["sb"], m["bb"], m["bc"]], [m["sc"], m["bc"], m["cc"]]]
    right = [m["sy"], m["by"], m["cy"]]
    base = det(columns)
    solved = {}
    for k, name in enumerate(("level", "slope", "curvature")):
        swapped = [[right[i] if j == k else columns[i][j] for j in range(3)] for i in range(3)]
        solved[name] = F.when(m["n"] >= least, safe_divide(det(swapped), base))
    return sums.select("week", *[v.alias(k) for k, v in solved.items()], (m["n"] / len(maturities)).alias("coverage"))


def factor_scores(z: DataFrame, weights: dict[str, float], stress: bool = False) -> DataFrame:
    """tanh(mean / 2) of the signed mean of available z-scores of (week, name, z); none available counts as 0."""
    table = z.sparkSession.createDataFrame(list(weights.items()), "name string, sign double")
    mean = F.coalesce(F.avg(F.col("z") * F.col("sign")), F.lit(0.0))
    return z.join(F.broadcast(table), "name").groupBy("week").agg(clip(F.tanh(mean / 2) * (-1.0 if stress else 1.0), -1.0, 1.0).alias("score"))


def worst_health(statuses: DataFrame, order: list[str]) -> DataFrame:
    """The most severe status of (key, status); ``order`` runs from the mildest, and a status that it lacks is the worst."""
    worst = F.max(F.struct(severity(F.col("status"), order).alias("at"), F.col("status").alias("s")))
    return statuses.filter("status IS NOT NULL").groupBy("key").agg(worst["s"].alias("status"))

"""Model selection with paired tests, and the evidence shown beside a forecast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import metrics

#: Fixed values of the paired test.
BLOCK_WEEKS = 13
RESAMPLES = 1_999
SEED = 17


def _lookup(values: dict[str, int], other: int = 99) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("model")), F.lit(other))


def block_bootstrap(improvements: DataFrame, keys: list[str], model: str, order: str, block: int = BLOCK_WEEKS, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(keys, model, n, mean_improvement, p): chance of a mean improvement as large as seen under circular block resampling.

    ``improvements`` has (keys, model, order, improvement). The models of one key share their draws, so they must have
    equally many improvements, all finite; else the job fails. A group is one model's series of weeks.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)["improvement"].to_numpy(float)
        n = len(values)
        if n != frame["_expected"].iloc[0]:
            raise ValueError("paired improvements must have equal lengths")
        if not np.isfinite(values).all():
            raise ValueError("paired improvements must be finite")
        length = min(block, max(1, n // 2))
        starts = np.random.default_rng(seed).integers(0, n, size=(resamples, -(-n // length)))
        seen, centred = values.mean(), values - values.mean()
        at_least = 0
        for part in np.array_split(starts, max(1, resamples * n // 2_000_000)):  # bounds what is held at once
            at = ((part[:, :, None] + np.arange(length)) % n).reshape(len(part), -1)[:, :n]
            at_least += int((centred[at].mean(axis=1) >= seen).sum())
        row = {k: [frame[k].iloc[0]] for k in (*keys, model)}
        return pd.DataFrame(row | {"n": [n], "mean_improvement": [seen], "p": [(1 + at_least) / (resamples + 1)]})

    types = dict(improvements.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, model)) + ", n long, mean_improvement double, p double"
    rows = improvements.select(*keys, model, order, "improvement")
    lengths = rows.groupBy(*keys, model).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_expected"))
    return rows.join(lengths, keys).groupBy(*keys, model).applyInPandas(run, schema)


def block_sign_test(improvements: DataFrame, keys: list[str], model: str, order: str, block: int = BLOCK_WEEKS) -> DataFrame:
    """(keys, model, blocks, better, p): chance that as many block means are above 0 if each were so with one half.

    Blocks are ``block`` rows in a row, the last one may be shorter; block means of 0 do not count. Unlike the bootstrap it
    draws nothing, so it is a few aggregations for any number of models.
    """
    place = F.row_number().over(Window.partitionBy(*keys, model).orderBy(order)) - 1
    means = improvements.withColumn("_block", F.floor(place / block)).groupBy(*keys, model, "_block").agg(F.round(F.avg("improvement"), 9).alias("m"))
    counts = means.groupBy(*keys, model).agg(F.count(F.when(F.col("m") != 0, 1)).alias("blocks"), F.count(F.when(F.col("m") > 0, 1)).alias("better"))
    ways = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(1.0), lambda acc, j: F.when(i < 1, 1.0).otherwise(acc * (F.col("blocks") - i + j) / j))
    tail = F.aggregate(F.sequence(F.col("better").cast("int"), F.col("blocks").cast("int")), F.lit(0.0), lambda acc, i: acc + ways(i))
    return counts.withColumn("p", tail / F.pow(F.lit(2.0), F.col("blocks")))


def gated_champion(
    board: DataFrame, pvalues: DataFrame, keys: list[str], baselines: list[str], complexity: dict[str, int],
    gain: float = 0.05, level: float = 0.05, brier: float = 0.01, near: float = 0.01,
) -> DataFrame:
    """(keys, model, reference, p_holm, gate_reason, selected) of every candidate.

    The reference is the best baseline. A candidate passes with no fallback, enough gain, a small adjusted p-value and
    no worse Brier score; of those near the best passing one, the simplest is selected.
    """
    rows = board.withColumn("rank", _lookup(complexity))
    if "fallback_count" not in rows.columns:
        rows = rows.withColumn("fallback_count", F.lit(0))
    is_base = F.col("model").isin(baselines)
    reference = rows.filter(is_base).groupBy(*keys).agg(F.min(F.struct("log_loss", "calibration_error", "model", "brier")).alias("ref"))
    adjusted = metrics.holm(pvalues, keys).select(*keys, "model", "p_holm")
    gated = rows.filter(~is_base).join(reference, keys).join(adjusted, [*keys, "model"], "left")
    gated = gated.withColumn(
        "gate_reason",
        F.when(F.col("fallback_count") > 0, "fallbacks")
        .when(F.col("ref.log_loss") - F.col("log_loss") < gain, "gain")
        .when(F.coalesce(F.col("p_holm") > level, F.lit(True)), "p_value")
        .when(F.col("brier") > F.col("ref.brier") + brier, "brier")
        .otherwise("passed"),
    )
    per_key = Window.partitionBy(*keys)
    best = F.min(F.when(F.col("gate_reason") == "passed", F.col("log_loss"))).over(per_key)
    close = (F.col("gate_reason") == "passed") & (F.col("log_loss") <= F.col("_best") + near)
    first = F.min(F.when(close, F.struct("rank", "calibration_error", "log_loss", "model"))).over(per_key)
    picked = gated.withColumn("_best", best).withColumn("_first", first)
    return picked.select(
        *keys, "model", F.col("ref.model").alias("reference"), "p_holm", "gate_reason", F.coalesce(F.col("model") == F.col("_first.model"), F.lit(False)).alias("selected")
    )


def event_champion(board: DataFrame, keys: list[str], baselines: list[str], complexity: dict[str, int], gain: float = 0.005, brier: float = 0.005) -> DataFrame:
    """(keys, champion, beats_baseline): the best by log loss, Brier score, complexity and name that beats the best baseline."""
    rows = board.withColumn("rank", _lookup(complexity))
    order = F.struct("log_loss", "brier", "rank", "model")
    base = rows.filter(F.col("model").isin(baselines)).groupBy(*keys).agg(F.min(order).alias("base"))
    passing = rows.filter(~F.col("model").isin(baselines)).join(base, keys)
    passing = passing.filter((F.col("log_loss") <= F.col("base.log_loss") - gain) & (F.col("brier") <= F.col("base.brier") + brier))
    winner = passing.groupBy(*keys).agg(F.min(order).alias("w"))
    return base.join(winner, keys, "left").select(*keys, F.coalesce("w.model", "base.model").alias("champion"), F.col("w").isNotNull().alias("beats_baseline"))


def evidence_drivers(z: DataFrame, keys: list[str], adverse: list[str], limit: int = 8) -> DataFrame:
    """(keys, feature, place, value, impact, direction): the ``limit`` scores of (keys, feature, value) furthest from 0.

    The limit is the feature: a top-k report. Ties go by name.
    """
    usable = z.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "feature"))
    impact = F.when(F.col("feature").isin(adverse), -F.col("value")).otherwise(F.col("value"))
    return (
        usable.withColumns({"place": place, "impact": impact})
        .filter(F.col("place") <= limit)
        .select(
            *keys, "feature", "place", F.round("value", 4).alias("value"), F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), "impact")), 4).alias("impact"),
            F.when(F.col("impact") >= 0, "risk_on").otherwise("risk_off").alias("direction"),
        )
    )


def risk_history(diagnostic: DataFrame, prospective: DataFrame, champions: DataFrame, keys: list[str], origin: str = "origin") -> DataFrame:
    """(keys, origin, risks): the champions' forecasts by horizon as a map, scored and prospective ones together."""
    columns = [*keys, origin, "horizon", "model", "p_change"]
    both = diagnostic.select(columns).unionByName(prospective.select(columns))
    own = both.join(champions.select(*keys, "horizon", F.col("champion").alias("model")), [*keys, "horizon", "model"])
    return own.groupBy(*keys, origin).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "p_change")))).alias("risks"))

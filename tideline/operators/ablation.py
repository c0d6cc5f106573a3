"""Feature ablation: one candidate over named sets of columns, scored against an anchor on the same origins.

Each variant is a plan of its own and all are one union, so their fits run side by side. A variant's losses are compared
with the anchor's on the very same rows, by a window over the variants of one origin. Ranks come from selection rows only.

Defined results: a variant with a fallback in selection is not eligible and ranks behind those that are, by name; if none is
eligible, the anchor is first; an origin that not all variants forecast, or whose outcome or state differs between them,
fails the scoring (``unpaired`` lists such rows); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import metrics

ORIGIN = ["origin", "target_week"]


def variants_of(groups: dict[str, list[str]], anchor: str, anchor_groups: list[str], extra: dict[str, list[str]]) -> dict[str, list[str]]:
    """Columns by variant: the anchor's groups, the anchor with each named list of further groups, and all groups.

    Groups must not share columns, and every name must be a group.
    """
    seen = [c for columns in groups.values() for c in columns]
    if len(seen) != len(set(seen)):
        raise ValueError("feature groups share columns")
    wanted = {anchor: anchor_groups} | {f"{anchor}_plus_{name}": [*anchor_groups, *more] for name, more in extra.items()} | {"all": list(groups)}
    return {name: [c for g in dict.fromkeys(own) for c in groups[g]] for name, own in wanted.items()}


def fan_out(frame: DataFrame, variants: dict[str, list[str]], fit: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The forecasts of ``fit`` over each variant's columns, with the column variant."""
    parts = [fit(frame, columns).withColumn("variant", F.lit(name)) for name, columns in variants.items()]
    return reduce(DataFrame.unionByName, parts)


def unpaired(predictions: DataFrame, keys: list[str], variants: int) -> DataFrame:
    """Origins that not all variants forecast once, or whose outcome, state or split differs between them."""
    facts = F.struct("actual", "current_state", "evaluation_split")
    seen = predictions.groupBy(*keys, *ORIGIN).agg(F.count_distinct("variant").alias("n_variants"), F.count(F.lit(1)).alias("n_rows"), F.size(F.collect_set(facts)).alias("n_facts"))
    return seen.filter((F.col("n_variants") != variants) | (F.col("n_rows") != variants) | (F.col("n_facts") != 1))


def leaderboard(predictions: DataFrame, keys: list[str], anchor: str, variants: int) -> DataFrame:
    """Scores by (keys, variant, evaluation_split), paired_n and the mean paired differences of log loss and Brier score
    (variant less anchor: below 0 is better), selection_rank and selection_winner.

    ``predictions`` holds (keys, variant, origin, target_week, evaluation_split, current_state, actual, p_<state>) and may
    hold ``fallback``.
    """
    fell = F.col("fallback") if "fallback" in predictions.columns else F.lit(False)
    rows = metrics.prepared(predictions.withColumn("_fell", fell)).withColumns({"_loss": -F.ln("hit"), "_square": metrics.brier_term()})
    at = Window.partitionBy(*keys, "evaluation_split", *ORIGIN)
    is_anchor = F.col("variant") == anchor
    odd = (F.count(F.lit(1)).over(at) != variants) | (F.count(F.when(is_anchor, 1)).over(at) != 1) | (F.min("actual").over(at) != F.max("actual").over(at))
    own = lambda c: F.col(c) - F.max(F.when(is_anchor, F.col(c))).over(at)
    refused = F.raise_error(F.lit("variants do not share their origins and outcomes")).cast("double")
    paired = rows.withColumns({"_d_loss": F.when(odd, refused).otherwise(own("_loss")), "_d_square": own("_square")})
    group = [*keys, "variant", "evaluation_split"]
    scores = paired.groupBy(*group).agg(
        F.avg("_loss").alias("log_loss"), F.avg("_square").alias("brier"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("paired_n"), F.avg("_d_loss").alias("log_loss_delta"), F.avg("_d_square").alias("brier_delta"), F.count(F.when(F.col("_fell"), 1)).alias("fallback_count"),
    )
    board = scores.join(metrics.calibration_error(rows, group), group)
    per_key = Window.partitionBy(*keys)
    eligible = F.col("fallback_count") == 0
    chosen = board.filter(F.col("evaluation_split") == "selection")
    chosen = chosen.withColumn("_ok", F.when(F.max(eligible).over(per_key), eligible).otherwise(F.col("variant") == anchor))
    order = per_key.orderBy(F.desc("_ok"), *[F.when(F.col("_ok"), F.round(c, 9)) for c in ("log_loss", "brier", "calibration_error")], "variant")
    ranks = chosen.select(*keys, "variant", F.row_number().over(order).cast("long").alias("selection_rank"))
    return board.join(ranks, [*keys, "variant"], "left").withColumn("selection_winner", F.coalesce(F.col("selection_rank") == 1, F.lit(False)))

"""Learned candidates on the weekly order panel.

The fits have no SQL, as they are iterative: tests compare them with their conditions of optimality and with prefixes of
the data. The embargo has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import discriminant, labels, learned, metrics, selection, transitions
from tideline.operators.labels import STATES, STRESS, TREND
from tideline.plans.forecast_queries import BASE, BASELINES, COMPLEXITY, HAZ, SPLIT, TRAIN_WEEKS, _fitted, hazards, walk
from tideline.plans.registry import register
from tideline.plans.selection_queries import paired_pvalues
from tideline.session import materialize
from tideline.sources.panel import order_panel

FEATURES = [*TREND, *STRESS, "trend_score", "stress_score", "risk_score"]


def _inputs(spark, sf_dir):
    """(series_id, week, state, features): the label's components and scores."""
    scores = materialize(_fitted(spark, sf_dir), "scores")
    states = labels.label(scores).select("series_id", "week", "state")
    parts = labels.components(order_panel(spark, sf_dir)).select("series_id", "week", *TREND, *STRESS)
    joined = states.join(scores.drop("lower", "upper"), ["series_id", "week"]).join(parts, ["series_id", "week"])
    return materialize(joined, "model-inputs")


def logistic(spark, sf_dir):
    return materialize(learned.walk_forward(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS), "logistic-walk")


@register("m06_m07_v01_logistic_walk_forward", dates=())
def m06(spark, sf_dir):
    return rounded(logistic(spark, sf_dir))


@register("m15_t03_duration_hurdle", dates=())
def m15(spark, sf_dir):
    return rounded(learned.hurdle(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS))


@register("m08_shrinkage_discriminant", dates=())
def m08(spark, sf_dir):
    """Not in SQL: every origin solves a small system; tests compare it with a plain refit."""
    return rounded(discriminant.walk_forward(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS))


@register("m05_elastic_net", dates=())
def m05(spark, sf_dir):
    return rounded(learned.split_forecasts(_inputs(spark, sf_dir), FEATURES, "elastic", SPLIT))


@register("m09_spline_logistic", dates=())
def m09(spark, sf_dir):
    return rounded(learned.split_forecasts(_inputs(spark, sf_dir), FEATURES, "spline", SPLIT))


@register("m11_random_forest", dates=())
def m11(spark, sf_dir):
    return rounded(learned.split_forecasts(_inputs(spark, sf_dir), FEATURES, "forest", SPLIT))


@register("m14_boosted_trees", dates=())
def m14(spark, sf_dir):
    return rounded(learned.split_forecasts(_inputs(spark, sf_dir), FEATURES, "boosted", SPLIT))


@register("t04_logistic_hazards", dates=())
def t04(spark, sf_dir):
    return rounded(learned.hazards(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS))


@register("t05_boosted_hazards", dates=())
def t05(spark, sf_dir):
    """Not in SQL: the trees are those of pyspark.ml; tests hold them against the data they may see."""
    return rounded(learned.boosted_hazards(_inputs(spark, sf_dir), FEATURES, SPLIT))


@register("t07_platt_calibration", dates=())
def t07(spark, sf_dir):
    raw = materialize(learned.hazards(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS, (1, 4)), "raw-hazards")
    return rounded(learned.platt(transitions.with_split(raw, SPLIT), ["series_id", "horizon", "model"]))


@register("v12_gated_champion", dates=())
def v12(spark, sf_dir):
    """Baselines, class prior and logistic candidates through the gates; the p-values are those of the bootstrap."""
    columns = ["series_id", "origin", "target_week", "pos", "current_state", "actual", "train_size", "model", *[f"p_{s}" for s in STATES]]
    learnt = logistic(spark, sf_dir)
    forecasts = materialize(walk(spark, sf_dir).select(columns).unionByName(learnt.select(columns)), "all-forecasts")
    fell = learnt.groupBy("series_id", "model").agg(F.count(F.when(F.col("fallback"), 1)).alias("fallback_count"))
    board = metrics.leaderboard(forecasts, ["series_id", "model"]).join(fell, ["series_id", "model"], "left").fillna({"fallback_count": 0})
    board = materialize(rounded(board, places=9), "board")
    ranks = COMPLEXITY | {"ridge_logistic": 2, "transition_logistic": 3}
    return rounded(selection.gated_champion(board, paired_pvalues(forecasts).select("series_id", "model", "p"), ["series_id"], BASELINES, ranks))


@register(
    "v03_embargo",
    BASE
    + HAZ
    + f""" SELECT series_id, origin, CAST(horizon AS BIGINT) AS horizon,
 CASE WHEN origin + 7 * horizon < DATE '{SPLIT}' THEN 'selection' ELSE 'diagnostic' END AS evaluation_split
FROM haz WHERE model = 'markov_hazard' AND (origin + 7 * horizon < DATE '{SPLIT}' OR origin >= DATE '{SPLIT}')""",
    dates=("origin",),
)
def v03(spark, sf_dir):
    origins = hazards(spark, sf_dir).filter("model = 'markov_hazard'").select("series_id", "origin", "horizon")
    return learned.embargoed(origins, SPLIT)

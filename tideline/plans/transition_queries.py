"""The transition benchmark over the order panel: nested selection, thresholds, leaderboard and prospective forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import learned, transitions
from tideline.plans.feature_queries import r6
from tideline.plans.forecast_queries import BASE, HAZ, SPLIT, TRAIN_WEEKS, _haz, _rat, hazards, labelled
from tideline.plans.learned_queries import FEATURES, _inputs
from tideline.plans.registry import register
from tideline.session import materialize

#: The Markov hazard stands as the challenger, as the learned ones have no SQL.
BASELINES = ["empirical_hazard"]
DIAG = "retrospective_diagnostic"

SCORED = f""", fs AS (SELECT series_id, CAST(horizon AS BIGINT) AS horizon, model, origin, actual_change AS y, round(p_change, 9) AS p, origin + CAST(7 * horizon AS INT) AS te FROM haz),
f AS (SELECT *, CASE WHEN te < DATE '{SPLIT}' THEN 'selection' ELSE '{DIAG}' END AS sp, CASE WHEN y THEN -ln(p) ELSE -ln(1 - p) END AS loss, pow(p - CAST(y AS INT), 2) AS sq FROM fs WHERE te < DATE '{SPLIT}' OR origin >= DATE '{SPLIT}'),
q AS (SELECT DISTINCT series_id, horizon, origin, sp FROM f),
hi AS (SELECT q.series_id, q.horizon, q.origin, h.model, count(*) AS n, round(avg(loss), 9) AS ll, round(avg(sq), 9) AS br FROM q JOIN f h ON h.series_id = q.series_id AND h.horizon = q.horizon AND h.sp = 'selection' AND h.te < q.origin GROUP BY 1, 2, 3, 4),
pick AS (SELECT b.series_id, b.horizon, b.origin, b.n, coalesce(w.model, b.model) AS m, CASE WHEN w.model IS NULL THEN 'conservative_probability_baseline_gate' ELSE 'passed_probability_baseline_gate' END AS why
 FROM hi b LEFT JOIN hi w ON w.series_id = b.series_id AND w.horizon = b.horizon AND w.origin = b.origin AND w.model = 'markov_hazard' AND w.ll <= b.ll - 0.005 AND w.br <= b.br + 0.005 WHERE b.model = 'empirical_hazard')"""


def scored(spark, sf_dir):
    return materialize(transitions.with_split(rounded(hazards(spark, sf_dir), places=9), SPLIT), "transition-forecasts")


@register(
    "t09_nested_selection",
    BASE
    + HAZ
    + SCORED
    + f""" SELECT q.series_id, q.horizon, q.origin, q.sp AS evaluation_split, CASE WHEN coalesce(n, 0) < 12 THEN 'markov_hazard' ELSE m END AS selected_model,
 CASE WHEN coalesce(n, 0) < 12 THEN 'fallback_family:insufficient_prequential_origins:' || coalesce(n, 0) || '<12' ELSE why END AS selection_reason, coalesce(n, 0) AS selection_history_origins, q.sp = '{DIAG}' AS selection_locked
FROM q LEFT JOIN pick USING (series_id, horizon, origin)""",
    dates=("origin",),
)
def t09(spark, sf_dir):
    return transitions.nested_selection(scored(spark, sf_dir), ["series_id"], BASELINES)


_GRID = f""", th AS (SELECT a.series_id, a.horizon, a.model, a.origin, t, count(*) AS n, count(*) FILTER (h.y) AS pos, count(*) FILTER (NOT h.y) AS neg, count(*) FILTER (h.y AND h.p >= t / 100) AS tp, count(*) FILTER (NOT h.y AND h.p < t / 100) AS tn
 FROM f a JOIN f h ON h.series_id = a.series_id AND h.horizon = a.horizon AND h.model = a.model AND h.sp = 'selection' AND h.te < a.origin, generate_series(5, 95) v(t) GROUP BY 1, 2, 3, 4, 5),
bt AS (SELECT series_id, horizon, model, origin, t / 100 AS threshold FROM th WHERE n >= 12 AND pos > 0 AND neg > 0 QUALIFY row_number() OVER (PARTITION BY series_id, horizon, model, origin ORDER BY round((tp / pos + tn / neg) / 2, 10) DESC, abs(t - 50), t DESC) = 1),
pr AS (SELECT f.*, coalesce(threshold, 0.5) AS threshold, p >= coalesce(threshold, 0.5) AS hat FROM f LEFT JOIN bt USING (series_id, horizon, model, origin))"""


@register(
    "v15_prequential_thresholds",
    BASE + HAZ + SCORED + _GRID + " SELECT series_id, horizon, model, origin, threshold FROM pr",
    dates=("origin",),
)
def v15_thresholds(spark, sf_dir):
    return transitions.prequential_thresholds(scored(spark, sf_dir), ["series_id"])


@register(
    "v15_transition_benchmark",
    BASE
    + HAZ
    + SCORED
    + _GRID
    + f""", sel AS (SELECT series_id, horizon, model, round(avg(loss), 9) AS ll, round(avg(sq), 9) AS br FROM f WHERE sp = 'selection' GROUP BY 1, 2, 3),
ch AS (SELECT b.series_id, b.horizon, coalesce(w.model, b.model) AS champion FROM sel b LEFT JOIN sel w ON w.series_id = b.series_id AND w.horizon = b.horizon AND w.model = 'markov_hazard' AND w.ll <= b.ll - 0.005 AND w.br <= b.br + 0.005 WHERE b.model = 'empirical_hazard')
SELECT series_id, horizon, model, sp AS evaluation_split, {r6('avg(loss)', 'log_loss')}, {r6('avg(sq)', 'brier')}, {r6(_rat('count(*) FILTER (y AND hat)', 'count(*) FILTER (hat)'), '"precision"')}, {r6(_rat('count(*) FILTER (y AND hat)', 'count(*) FILTER (y)'), 'recall')},
 {r6('count(*) FILTER (hat AND NOT y) / greatest(count(*) / 52.1775, 1 / 52.1775)', 'false_alarms_per_year')}, count(*) AS n_predictions, count(*) FILTER (y) AS event_count, model = any_value(champion) AS selected
FROM pr JOIN ch USING (series_id, horizon) GROUP BY 1, 2, 3, 4""",
    dates=(),
)
def v15(spark, sf_dir):
    """The leaderboard by split, with the champion of the selection rows marked."""
    return rounded(transitions.benchmark(scored(spark, sf_dir), ["series_id"], BASELINES)["leaderboard"])


@register("v15_learned_transition_benchmark", dates=())
def v15_learned(spark, sf_dir):
    """The nested selection with the calibrated logistic hazards as challengers: not in SQL, as the fits are iterative."""
    raw = materialize(learned.hazards(_inputs(spark, sf_dir), FEATURES, TRAIN_WEEKS), "raw-hazards")
    fitted = transitions.with_split(raw, SPLIT)
    known = fitted.select("series_id", "horizon", "model", "origin", "current_state", "fallback")
    calibrated = learned.platt(fitted, ["series_id", "horizon", "model"], least=12).join(known, ["series_id", "horizon", "model", "origin"])
    columns = ["series_id", "horizon", "model", "origin", "current_state", "actual_change", "p_change", "evaluation_split", "fallback"]
    own = calibrated.withColumn("p_change", F.col("p_calibrated")).select(columns)
    plain = scored(spark, sf_dir).withColumn("fallback", F.lit(False)).select(columns)
    both = materialize(plain.unionByName(own), "transition-candidates")
    return rounded(transitions.nested_selection(both, ["series_id"], ["empirical_hazard", "markov_hazard"]))


def _open(h: int) -> str:
    return _haz(h).replace("AND ev IS NOT NULL", "AND ev IS NULL")


@register(
    "t11_prospective_forecasts",
    BASE
    + ", "
    + ", ".join(map(_open, (1, 4, 13)))
    + ", pro AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, week AS origin, CAST({h} AS BIGINT) AS horizon, state AS current_state, n AS train_size, '{m}' AS model, {e} AS p_change, week + {7 * h} AS target_end FROM x{h}"
        for h in (1, 4, 13)
        for m, e in (("empirical_hazard", "(k + 1) / (n + 2)"), ("markov_hazard", f"1 - pow(stay, {h})"))
    )
    + ") SELECT series_id, origin, horizon, current_state, train_size, model, "
    + r6("p_change", "p_change")
    + ", target_end, 'prospective' AS evaluation_split FROM pro",
    dates=("origin", "target_end"),
)
def t11(spark, sf_dir):
    return rounded(transitions.prospective_hazards(labelled(spark, sf_dir).select("series_id", "week", "state"), TRAIN_WEEKS))

"""Structural candidates on the weekly order panel: joint forecasts, the ensemble, and the benchmark with both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import baselines, structural
from tideline.operators.labels import STATES
from tideline.plans.feature_queries import LAG, r6
from tideline.plans.forecast_queries import BASE, BASELINES, BOARD, HAZ, SPLIT, TRAIN_WEEKS, WALK, _CELLS, _MAJ, _OWN, _SCORES, _haz, hazards, labelled
from tideline.plans.registry import register
from tideline.session import materialize

#: A Markov forecast whose state was left fewer times than this gives way to the class prior.
VISITS = 40
EXPERTS = ["markov", "class_prior"]
COMPLEXITY = {"class_prior": 1, structural.JOINT: 2, structural.ENSEMBLE: 3}

_AUG = (
    f""", vis AS (SELECT series_id, week AS origin, o0 + o1 + o2 AS visits FROM oo),
fw AS (SELECT w.series_id, w.origin, w.target_week, w.current_state, w.actual, w.model, w.model = 'markov' AND visits < {VISITS} AS fell,
 """
    + ", ".join(f"CASE WHEN w.model = 'markov' AND visits < {VISITS} THEN c.p_{s} ELSE w.p_{s} END AS p_{s}" for s in STATES)
    + """ FROM walk w JOIN vis USING (series_id, origin) JOIN walk c ON c.series_id = w.series_id AND c.origin = w.origin AND c.model = 'class_prior'),
jn AS (SELECT f.*, h.p_change AS h, """
    + ", ".join(f"CASE WHEN f.current_state = '{s}' THEN 0 ELSE greatest(p_{s}, 1e-6) END AS g{i}" for i, s in enumerate(STATES))
    + " FROM fw f JOIN haz h ON h.series_id = f.series_id AND h.origin = f.origin AND h.horizon = 1 AND h.model = 'empirical_hazard' WHERE f.model = 'class_prior'), joint AS (SELECT series_id, origin, target_week, current_state, actual, 'hazard_destination' AS model, fell, "
    + ", ".join(f"CASE WHEN current_state = '{s}' THEN 1 - h ELSE h * g{i} / (g0 + g1 + g2) END AS p_{s}" for i, s in enumerate(STATES))
    + f""" FROM jn), cm AS (SELECT * FROM fw WHERE (series_id, origin) IN (SELECT (series_id, origin) FROM joint) UNION ALL SELECT * FROM joint),
ex AS (SELECT *, bool_or(fell) OVER (PARTITION BY series_id, origin) AS any_fell, -ln(least(greatest(CASE actual WHEN 'risk_on' THEN p_risk_on WHEN 'transition' THEN p_transition ELSE p_risk_off END, 1e-12), 1)) AS loss FROM cm WHERE model IN ('markov', 'class_prior', 'hazard_destination')),
dl AS (SELECT a.series_id, a.origin, a.model, count(b.loss) AS history_rows, max(b.target_week) AS latest_target, coalesce(sum(b.loss * pow(0.5, ((a.origin - b.target_week) / 7) / 52)), 0) AS d
 FROM ex a LEFT JOIN ex b ON b.series_id = a.series_id AND b.model = a.model AND b.target_week < a.origin AND NOT b.any_fell GROUP BY 1, 2, 3),
rw AS (SELECT ex.*, history_rows, latest_target, d, history_rows < 26 AS warmup, CASE WHEN fell THEN 0 WHEN history_rows < 26 THEN 1 ELSE exp(min(CASE WHEN NOT fell THEN d END) OVER (PARTITION BY series_id, origin) - d) END AS raw FROM ex JOIN dl USING (series_id, origin, model)),
ws AS (SELECT *, raw / sum(raw) OVER (PARTITION BY series_id, origin) AS weight FROM rw),
en AS (SELECT series_id, origin, target_week, any_value(current_state) AS current_state, any_value(actual) AS actual, 'causal_dynamic_ensemble' AS model, false AS fell, """
    + ", ".join(f"sum(weight * p_{s}) / sum(weight * (p_risk_on + p_transition + p_risk_off)) AS p_{s}" for s in STATES)
    + f""" FROM ws GROUP BY 1, 2, 3), aug AS (SELECT *, CASE WHEN target_week < DATE '{SPLIT}' THEN 'selection' ELSE 'holdout' END AS evaluation_split FROM (SELECT * FROM cm UNION ALL SELECT * FROM en))"""
)


def base_forecasts(states, rows):
    """``rows``, forecasts of the baselines over ``states``, with the Markov forecasts of rarely left states replaced by the class prior."""
    # a visit counts once its next state lies before the origin, hence two rows before it in the series
    at = Window.partitionBy("series_id").orderBy("week").rowsBetween(Window.unboundedPreceding, -2)
    seen = [F.count(F.when(F.col("state") == s, 1)).over(at) for s in STATES]
    visits = states.select("series_id", F.col("week").alias("origin"), F.when(F.col("state") == STATES[0], seen[0]).when(F.col("state") == STATES[1], seen[1]).otherwise(seen[2]).alias("visits"))
    rows = rows.join(visits, ["series_id", "origin"])
    prior = F.max(F.when(F.col("model") == "class_prior", F.struct(*structural.P))).over(Window.partitionBy("series_id", "origin"))
    rows = rows.withColumns({"_prior": prior, "fallback": (F.col("model") == "markov") & (F.col("visits") < VISITS)})
    replaced = {c: F.when(F.col("fallback"), F.col(f"_prior.{c}")).otherwise(F.col(c)) for c in structural.P}
    rows = rows.withColumns(replaced | {"fallback_reason": F.when(F.col("fallback"), F.format_string("visits:%d<%d", "visits", F.lit(VISITS))).otherwise("")})
    return rows.select("series_id", "origin", "target_week", "current_state", "actual", "model", *structural.P, "fallback", "fallback_reason")


def _augmented(spark, sf_dir):
    states = labelled(spark, sf_dir).select("series_id", "week", "state")
    base = materialize(base_forecasts(states, baselines.walk_forward(states, TRAIN_WEEKS)), "structural-base")
    hazard = hazards(spark, sf_dir).filter("horizon = 1 AND model = 'empirical_hazard'").drop("model")
    found = structural.augment(base, hazard, ["series_id"], "class_prior", EXPERTS)
    return found | {"predictions": materialize(baselines.split_of(found["predictions"], "target_week", SPLIT), "structural")}


@register(
    "v16_structural_predictions",
    WALK + HAZ + _AUG + " SELECT series_id, origin, target_week, model, current_state, actual, fell AS fallback, evaluation_split, " + ", ".join(r6(f"p_{s}", f"p_{s}") for s in STATES) + " FROM aug",
    dates=("origin", "target_week"),
)
def v16_predictions(spark, sf_dir):
    return rounded(_augmented(spark, sf_dir)["predictions"].drop("fallback_reason"))


@register(
    "m19_v16_stacking_weights",
    WALK + HAZ + _AUG + " SELECT series_id, origin, target_week, model AS expert, NOT fell AS eligible, history_rows, latest_target, warmup, " + r6("d", "discounted_log_loss") + ", " + r6("weight", "weight") + " FROM ws",
    dates=("origin", "target_week", "latest_target"),
)
def v16_weights(spark, sf_dir):
    return rounded(_augmented(spark, sf_dir)["weights"])


_SPLIT_BOARD = BOARD.replace("FROM walk", "FROM (SELECT * REPLACE (model || '|' || evaluation_split AS model) FROM aug)")


@register(
    "v16_structural_leaderboard",
    WALK
    + HAZ
    + _AUG
    + _SPLIT_BOARD
    + ", fb AS (SELECT series_id, model || '|' || evaluation_split AS model, count(*) FILTER (fell) AS fallback_count FROM aug GROUP BY 1, 2) SELECT series_id, split_part(model, '|', 1) AS model, split_part(model, '|', 2) AS evaluation_split, n_predictions, fallback_count, "
    + ", ".join(r6(c, c) for c in _SCORES)
    + " FROM full_board JOIN fb USING (series_id, model)",
    dates=(),
)
def v16_leaderboard(spark, sf_dir):
    board, _ = structural.regate(_augmented(spark, sf_dir)["predictions"], ["series_id"], BASELINES, COMPLEXITY)
    return rounded(board)


_GATES = """, rb AS (SELECT series_id, model, round(log_loss, 9) AS ll, round(brier, 9) AS br, round(calibration_error, 9) AS ce FROM full_board),
fb AS (SELECT series_id, model, count(*) FILTER (fell) AS fc FROM aug WHERE evaluation_split = 'selection' GROUP BY 1, 2),
rf AS (SELECT * FROM rb WHERE model IN ('majority', 'persistence', 'markov') QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ll, ce, model) = 1),
ls AS (SELECT series_id, model, origin, -ln(hit) AS loss FROM pp),
im AS (SELECT a.series_id, a.model, a.origin, b.loss - a.loss AS d FROM ls a JOIN rf ON rf.series_id = a.series_id JOIN ls b ON b.series_id = a.series_id AND b.origin = a.origin AND b.model = rf.model WHERE a.model NOT IN ('majority', 'persistence', 'markov')),
bl AS (SELECT series_id, model, (row_number() OVER (PARTITION BY series_id, model ORDER BY origin) - 1) // 13 AS b, d FROM im),
bm AS (SELECT series_id, model, b, round(avg(d), 9) AS m FROM bl GROUP BY 1, 2, 3),
bc AS (SELECT series_id, model, count(*) FILTER (m <> 0) AS blocks, count(*) FILTER (m > 0) AS better FROM bm GROUP BY 1, 2),
pv AS (SELECT series_id, model, round(list_sum(list_transform(range(better, blocks + 1), lambda i: round(exp(lgamma(blocks + 1) - lgamma(i + 1) - lgamma(blocks - i + 1))))) / pow(2, blocks), 12) AS p FROM bc),
hr AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY series_id) - row_number() OVER w + 1)) AS raw, row_number() OVER w AS k FROM pv WINDOW w AS (PARTITION BY series_id ORDER BY p, model)),
hm AS (SELECT series_id, model, max(raw) OVER (PARTITION BY series_id ORDER BY k) AS p_holm FROM hr),
gt AS (SELECT rb.*, rf.model AS reference, p_holm, CASE WHEN fc > 0 THEN 'fallbacks' WHEN rf.ll - rb.ll < 0.05 THEN 'gain' WHEN p_holm > 0.05 THEN 'p_value' WHEN rb.br > rf.br + 0.01 THEN 'brier' ELSE 'passed' END AS gate_reason
 FROM rb JOIN rf USING (series_id) JOIN hm ON hm.series_id = rb.series_id AND hm.model = rb.model JOIN fb ON fb.series_id = rb.series_id AND fb.model = rb.model),
nr AS (SELECT series_id, model FROM (SELECT *, min(ll) OVER (PARTITION BY series_id) AS best FROM gt WHERE gate_reason = 'passed') WHERE ll <= best + 0.01
 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY CASE model WHEN 'class_prior' THEN 1 WHEN 'hazard_destination' THEN 2 ELSE 3 END, ce, ll, model) = 1)
SELECT gt.series_id, gt.model, reference, round(p_holm, 6) + 0.0 AS p_holm, gate_reason, nr.model IS NOT NULL AS selected FROM gt LEFT JOIN nr ON nr.series_id = gt.series_id AND nr.model = gt.model"""


@register("v16_structural_gates", WALK + HAZ + _AUG + BOARD.replace("FROM walk", "FROM (SELECT * FROM aug WHERE evaluation_split = 'selection')") + _GATES, dates=())
def v16_gates(spark, sf_dir):
    """A family of three challengers a series against its best baseline, on selection rows only."""
    _, gates = structural.regate(_augmented(spark, sf_dir)["predictions"], ["series_id"], BASELINES, COMPLEXITY)
    return rounded(gates)


AS_OF = "2000-07-01"
_SAY = [("majority", [f"CASE WHEN {_MAJ} = '{s}' THEN 1.0 ELSE 1e-9 END" for s in STATES]), ("persistence", [f"CASE WHEN state = '{s}' THEN 1.0 ELSE 1e-9 END" for s in STATES])]
_SAY += [("markov", [f"(o{j} + 1) / (o0 + o1 + o2 + 3)" for j in range(3)]), ("class_prior", [f"(n{j} + 1) / (n0 + n1 + n2 + 3)" for j in range(3)])]


@register(
    "v14_forecast_next",
    BASE
    + f", nx AS (SELECT *, lead(state) {LAG} AS nxt FROM lab WHERE week <= DATE '{AS_OF}'), cc AS (SELECT *, {_CELLS} FROM nx), la AS (SELECT *, {_OWN} FROM cc QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY week DESC) = 1) "
    + " UNION ALL ".join(
        f"SELECT series_id, week AS origin, '{m}' AS model, state AS current_state, n0 + n1 + n2 AS train_size, " + ", ".join(r6(f"CASE WHEN pos - 1 >= {TRAIN_WEEKS} THEN ({x}) / ({' + '.join(f'({y})' for y in p)}) END", f"p_{s}") for x, s in zip(p, STATES, strict=True)) + f", CASE WHEN pos - 1 >= {TRAIN_WEEKS} THEN 'ok' ELSE 'not_enough_history:' || greatest(pos - 1, 0) || '<{TRAIN_WEEKS}' END AS status FROM la"
        for m, p in _SAY
    ),
    dates=("origin",),
)
def v14(spark, sf_dir):
    return rounded(baselines.forecast_next(labelled(spark, sf_dir).select("series_id", "week", "state"), TRAIN_WEEKS, AS_OF))


_OPEN_WALK = WALK.replace("AND nxt IS NOT NULL", "").replace(f"lead(week) {LAG} AS target_week", f"coalesce(lead(week) {LAG}, week + 7) AS target_week")
_OPEN_HAZ = f", {_haz(1).replace('AND ev IS NOT NULL', '')}, haz AS (SELECT series_id, week AS origin, 1 AS horizon, 'empirical_hazard' AS model, (k + 1) / (n + 2) AS p_change FROM x1)"


@register(
    "m21_structural_forecast",
    _OPEN_WALK
    + _OPEN_HAZ
    + _AUG
    + " SELECT a.series_id, a.origin, a.target_week, a.model, a.current_state, a.fell AS fallback, "
    + ", ".join(r6(f"a.p_{s}", f"p_{s}") for s in STATES)
    + ", "
    + r6("weight", "weight")
    + ", "
    + ", ".join(r6(f"1 - pow(1 - p_change, {h})", f"p_change_{h}w") for h in (1, 4, 13))
    + " FROM aug a LEFT JOIN ws ON ws.series_id = a.series_id AND ws.origin = a.origin AND ws.model = a.model JOIN haz h ON h.series_id = a.series_id AND h.origin = a.origin QUALIFY a.origin = max(a.origin) OVER (PARTITION BY a.series_id)",
    dates=("origin", "target_week"),
)
def m21(spark, sf_dir):
    states = labelled(spark, sf_dir).select("series_id", "week", "state")
    rows = baselines.forecast_rows(states).filter(F.col("pos") >= TRAIN_WEEKS + 1)
    base = materialize(base_forecasts(states, rows), "structural-open")
    hazard = baselines.hazard_rows(states, TRAIN_WEEKS, 1).filter("model = 'empirical_hazard'").drop("model").withColumnRenamed("event", "actual_change")
    found = structural.forecast(base, materialize(hazard, "open-hazards"), ["series_id"], "class_prior", EXPERTS)
    return rounded(found.drop("actual", "fallback_reason"))

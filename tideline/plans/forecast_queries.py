"""Label, baseline and metric queries on the weekly order panel, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import baselines, features, labels, metrics
from tideline.operators.labels import STATES, STRESS, TREND
from tideline.plans.feature_queries import LAG, r6, roll
from tideline.plans.registry import register
from tideline.session import materialize
from tideline.sources.panel import ORDER_PANEL_SQL, order_panel

TRAIN_WEEKS = 104
SPLIT = "2000-01-07"
OTHERS = ("week",)


def _z(x: str, place: str = "") -> str:
    return f"({x} - {place}{x}_c) / {place}{x}_s"


def _stats(columns: tuple[str, ...], source: str, name: str) -> str:
    """Robust centre and scale per series, as two CTEs."""
    q = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_c, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349 AS {c}_i" for c in columns)
    s = ", ".join(f"any_value({c}_c) AS {c}_c, CASE WHEN any_value({c}_i) > 1e-12 THEN any_value({c}_i) WHEN median(abs({c} - {c}_c)) * 1.4826 > 1e-12 THEN median(abs({c} - {c}_c)) * 1.4826 ELSE 1 END AS {c}_s" for c in columns)
    return f"{name}_q AS (SELECT series_id, {q} FROM {source} GROUP BY 1), {name} AS (SELECT series_id, {s} FROM {source} JOIN {name}_q USING (series_id) GROUP BY 1)"


def _mean(columns: tuple[str, ...]) -> str:
    z = [_z(c) for c in columns]
    return f"list_avg(list_filter([{', '.join(z)}], lambda x: x IS NOT NULL))"


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) >= 1e-12 THEN ({a}) / ({b}) END"


_PARTS = ", ".join(
    [_safe(f"lnp - lag(lnp, {n}) {LAG}", f"(({roll('stddev_pop', 'r', n, max(4, n // 2))}) * {math.sqrt(n)!r})") + f" AS trend_{n}w" for n in (13, 26)]
    + [f"({roll('stddev_pop', 'r', n, max(2, n // 2))}) * {math.sqrt(52)!r} AS vol_{n}w" for n in (4, 13)]
    + [f"1 - price / ({roll('max', 'price', n, max(4, n // 2))}) AS drawdown_{n}w" for n in (13, 52)]
)
BASE = f"""WITH RECURSIVE {ORDER_PANEL_SQL}, p AS (SELECT *, CASE WHEN price > 0 THEN ln(price) END AS lnp FROM panel), r AS (SELECT *, lnp - lag(lnp, 1) {LAG} AS r FROM p),
comp AS (SELECT series_id, week, row_number() {LAG} AS n, {_PARTS} FROM r), train AS (SELECT * FROM comp WHERE n <= {TRAIN_WEEKS}), {_stats(TREND + STRESS, 'train', 'st')},
raw AS (SELECT series_id, week, n, {_mean(TREND)} AS trend_raw, {_mean(STRESS)} AS stress_raw FROM comp JOIN st USING (series_id)),
traw AS (SELECT * FROM raw WHERE n <= {TRAIN_WEEKS}), {_stats(('trend_raw', 'stress_raw'), 'traw', 'sc')},
sco AS (SELECT series_id, week, n, {_z('trend_raw')} AS trend_score, {_z('stress_raw')} AS stress_score FROM raw JOIN sc USING (series_id)),
lim AS (SELECT series_id, round(quantile_cont(trend_score - stress_score, 0.3), 8) AS lower, round(quantile_cont(trend_score - stress_score, 0.7), 8) AS upper FROM sco WHERE n <= {TRAIN_WEEKS} GROUP BY 1),
scored AS (SELECT series_id, week, n, trend_score, stress_score, round(trend_score - stress_score, 8) AS risk_score, lower, upper FROM sco JOIN lim USING (series_id)),
fsm AS (SELECT series_id, CAST(0 AS BIGINT) AS n, 'transition' AS state FROM lim UNION ALL
 SELECT s.series_id, s.n, CASE WHEN v IS NULL THEN state
  WHEN state = 'transition' THEN CASE WHEN v <= lower THEN 'risk_off' WHEN v >= upper THEN 'risk_on' ELSE state END
  WHEN state = 'risk_on' THEN CASE WHEN v <= lower - m THEN 'risk_off' WHEN v < upper - m THEN 'transition' ELSE state END
  ELSE CASE WHEN v >= upper + m THEN 'risk_on' WHEN v > lower + m THEN 'transition' ELSE state END END
 FROM fsm JOIN (SELECT *, risk_score AS v, (upper - lower) * 0.15 AS m FROM scored) s ON s.series_id = fsm.series_id AND s.n = fsm.n + 1),
lab AS (SELECT s.series_id, s.week, s.n - 1 AS pos, s.risk_score, s.lower, s.upper, s.trend_score, s.stress_score, f.state FROM scored s JOIN fsm f USING (series_id, n))"""


def _fitted(spark, sf_dir):
    return labels.fitted(order_panel(spark, sf_dir), TRAIN_WEEKS)["scores"]


def labelled(spark, sf_dir):
    return materialize(labels.label(_fitted(spark, sf_dir)), "labelled")


@register("l01_label_components", BASE + " SELECT series_id, week, " + ", ".join(r6(c, c) for c in TREND + STRESS) + " FROM comp")
def l01(spark, sf_dir):
    return rounded(labels.components(order_panel(spark, sf_dir)).select("series_id", "week", *TREND, *STRESS))


@register("l02_robust_stats", BASE + " SELECT series_id, " + ", ".join(r6(f"{c}_c", f"{c}_centre") + ", " + r6(f"{c}_s", f"{c}_scale") for c in TREND + STRESS) + " FROM st", dates=())
def l02(spark, sf_dir):
    return rounded(labels.fitted(order_panel(spark, sf_dir), TRAIN_WEEKS)["parts"])


@register("l03_label_thresholds", BASE + " SELECT series_id, " + r6("lower", "lower") + ", " + r6("upper", "upper") + " FROM lim", dates=())
def l03(spark, sf_dir):
    return rounded(labels.fitted(order_panel(spark, sf_dir), TRAIN_WEEKS)["limits"])


@register("l04_scores", BASE + " SELECT series_id, week, " + ", ".join(r6(c, c) for c in ("trend_score", "stress_score", "risk_score")) + " FROM scored")
def l04(spark, sf_dir):
    return rounded(_fitted(spark, sf_dir).drop("lower", "upper"))


@register("l05_hysteresis_states", BASE + " SELECT series_id, week, state FROM lab")
def l05(spark, sf_dir):
    return labelled(spark, sf_dir).select("series_id", "week", "state")


_W = "greatest(upper - lower, 1e-6)"
_LOGITS = [f"coalesce(-pow((risk_score - ({a})) / {_W}, 2) / 0.75, {m})" for a, m in ((f"upper + {_W} / 2", "-20.0"), ("(lower + upper) / 2", "0.0"), (f"lower - {_W} / 2", "-20.0"))]
SOFT = ", ".join(f"{x} AS g{i}" for i, x in enumerate(_LOGITS))
SOFT = f", soft AS (SELECT *, {SOFT} FROM lab), sm AS (SELECT *, exp(g0 - greatest(g0, g1, g2)) AS e0, exp(g1 - greatest(g0, g1, g2)) AS e1, exp(g2 - greatest(g0, g1, g2)) AS e2 FROM soft), prob AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM sm)"


@register("l06_state_probabilities", BASE + SOFT + " SELECT series_id, week, " + ", ".join(r6(f"p{i}", f"p_{s}") for i, s in enumerate(STATES)) + " FROM prob")
def l06(spark, sf_dir):
    return rounded(labels.state_probabilities(_fitted(spark, sf_dir)))


@register(
    "l09_estimate",
    BASE + SOFT + ", e AS (SELECT series_id, week, round(p0, 8) AS a, round(p1, 8) AS b, round(p2, 8) AS c FROM prob) SELECT series_id, week, CASE WHEN a = greatest(a, b, c) THEN 'risk_on' WHEN b = greatest(a, b, c) THEN 'transition' ELSE 'risk_off' END AS state, " + r6("greatest(a, b, c)", "confidence") + ", " + r6("-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END) / ln(3)", "entropy") + " FROM e",
)
def l09(spark, sf_dir):
    soft = labels.state_probabilities(_fitted(spark, sf_dir))
    return rounded(labels.estimate(soft, [f"p_{s}" for s in STATES]).select("series_id", "week", "state", "confidence", "entropy"))


@register("l10_align", BASE + SOFT + ", x AS (SELECT series_id, week, greatest(p0, 1e-9) AS a, 1e-9 AS b, greatest(p2, 1e-9) AS c FROM prob) SELECT series_id, week, " + r6("a / (a + b + c)", "p_risk_on") + ", " + r6("b / (a + b + c)", "p_transition") + ", " + r6("c / (a + b + c)", "p_risk_off") + " FROM x")
def l10(spark, sf_dir):
    soft = labels.state_probabilities(_fitted(spark, sf_dir))
    known = {"risk_on": "p_risk_on", "risk_off": "p_risk_off"}
    return rounded(labels.align(soft, known).select("series_id", "week", *[f"p_{s}" for s in STATES]))


def _ahead(h: int) -> str:
    full = f"count(*) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h}"
    first = f"list_filter(list(state) OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), lambda s: s <> state)"
    return f"SELECT *, {full} AS full_, {first} AS other FROM lab"


@register("l11_j09_transition_targets", BASE + f", t AS ({_ahead(4)}) SELECT series_id, week, state, CASE WHEN full_ THEN len(other) > 0 END AS event, CASE WHEN full_ THEN coalesce(other[1], state) END AS destination FROM t")
def l11(spark, sf_dir):
    return labels.transition_targets(labelled(spark, sf_dir), 4)


@register("l12_label_history", BASE + f" SELECT series_id, week, state, lag(state) {LAG} AS previous_state, coalesce(lag(state) {LAG} <> state, false) AS changed, " + ", ".join(r6(c, c) for c in ("risk_score", "lower", "upper")) + " FROM lab")
def l12(spark, sf_dir):
    return rounded(labels.label_history(labelled(spark, sf_dir)))


@register(
    "f19_transition_path",
    BASE + f", a AS (SELECT *, risk_score - lag(risk_score, 1) {LAG} AS d1, risk_score - lag(risk_score, 2) {LAG} AS d2, risk_score - lag(risk_score, 4) {LAG} AS d4, (risk_score - lower) / {_W} AS tl, (upper - risk_score) / {_W} AS tu FROM lab) SELECT series_id, week, " + ", ".join(f"round({x}, 8) + 0.0 AS {n}" for x, n in (("d1", "score_change_1w"), ("d2", "score_change_2w"), ("d4", "score_change_4w"), ("tl", "to_lower"), ("tu", "to_upper"), (f"d1 - lag(d1, 1) {LAG}", "score_acceleration"), ("least(abs(tl), abs(tu))", "nearest_boundary"), ("CASE WHEN state = 'risk_on' THEN -tu WHEN state = 'risk_off' THEN -tl ELSE least(tl, tu) END", "state_distance"))) + " FROM a",
)
def f19(spark, sf_dir):
    return rounded(features.transition_path(labelled(spark, sf_dir)).drop("risk_score", "state", "lower", "upper"), places=8)


RUNS = f", ch AS (SELECT *, coalesce(CAST(state <> lag(state) {LAG} AS INT), 1) AS st FROM lab), isl AS (SELECT *, sum(st) {LAG} AS run FROM ch), dur AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY week) AS duration FROM isl)"


@register("f20_state_durations", BASE + RUNS + " SELECT series_id, week, state, duration FROM dur")
def f20(spark, sf_dir):
    return features.state_durations(labelled(spark, sf_dir).select("series_id", "week", "state"))


@register(
    "l08_duration_summary",
    BASE + RUNS + ", runs AS (SELECT series_id, run, max(duration) AS n, max(week) AS last FROM dur GROUP BY 1, 2), k AS (SELECT *, max(run) OVER (PARTITION BY series_id) AS top FROM runs) SELECT series_id, count(*) - 1 AS n_changes, " + r6("avg(n) FILTER (run < top)", "mean_completed") + ", max(n) FILTER (run = top) AS latest_duration FROM k GROUP BY 1",
    dates=(),
)
def l08(spark, sf_dir):
    from pyspark.sql import Window

    runs = features.state_durations(labelled(spark, sf_dir).select("series_id", "week", "state"))
    after = F.lead("duration").over(Window.partitionBy("series_id").orderBy("week"))
    ends = runs.withColumn("next", after).filter((F.col("next") == 1) | F.col("next").isNull())
    done = F.col("next").isNotNull()
    return rounded(ends.groupBy("series_id").agg((F.count(F.lit(1)) - 1).alias("n_changes"), F.avg(F.when(done, F.col("duration"))).alias("mean_completed"), F.max(F.when(~done, F.col("duration"))).alias("latest_duration")))


_PRE = "OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
_CELLS = ", ".join(f"count(*) FILTER (state = '{a}' AND nxt = '{b}') {_PRE} AS c{i}{j}" for i, a in enumerate(STATES) for j, b in enumerate(STATES))
_OWN = ", ".join(f"CASE state WHEN 'risk_on' THEN c0{j} WHEN 'transition' THEN c1{j} ELSE c2{j} END AS o{j}, c0{j} + c1{j} + c2{j} AS n{j}" for j in range(3))
_HOT = lambda state: ", ".join(f"(CASE WHEN {state} = '{s}' THEN 1.0 ELSE 1e-9 END) / (1 + 2e-9) AS p_{s}" for s in STATES)
_MAJ = "CASE WHEN n0 = greatest(n0, n1, n2) THEN 'risk_on' WHEN n1 = greatest(n0, n1, n2) THEN 'transition' ELSE 'risk_off' END"
_COLS = "series_id, week AS origin, target_week, pos, state AS current_state, nxt AS actual, n0 + n1 + n2 AS train_size"
WALK = (
    BASE
    + f", nx AS (SELECT *, lead(state) {LAG} AS nxt, lead(week) {LAG} AS target_week FROM lab), cc AS (SELECT *, {_CELLS} FROM nx), oo AS (SELECT *, {_OWN} FROM cc WHERE pos >= {TRAIN_WEEKS + 1} AND nxt IS NOT NULL), "
    + f"walk AS (SELECT {_COLS}, 'majority' AS model, {_HOT(_MAJ)} FROM oo UNION ALL SELECT {_COLS}, 'persistence', {_HOT('state')} FROM oo UNION ALL SELECT {_COLS}, 'markov', (o0 + 1) / (o0 + o1 + o2 + 3), (o1 + 1) / (o0 + o1 + o2 + 3), (o2 + 1) / (o0 + o1 + o2 + 3) FROM oo"
    + f" UNION ALL SELECT {_COLS}, 'class_prior', (n0 + 1) / (n0 + n1 + n2 + 3), (n1 + 1) / (n0 + n1 + n2 + 3), (n2 + 1) / (n0 + n1 + n2 + 3) FROM oo)"
)


def walk(spark, sf_dir):
    forecasts = baselines.walk_forward(labelled(spark, sf_dir).select("series_id", "week", "state"), TRAIN_WEEKS)
    return materialize(forecasts, "walk")


@register("m01_m04_v01_walk_forward", WALK + " SELECT series_id, origin, target_week, pos, current_state, actual, train_size, model, " + ", ".join(r6(f"p_{s}", f"p_{s}") for s in STATES) + " FROM walk", dates=("origin", "target_week"))
def m01(spark, sf_dir):
    return rounded(walk(spark, sf_dir))


@register(
    "v02_split_budgets",
    WALK + f", s AS (SELECT DISTINCT series_id, origin, target_week, CASE WHEN target_week < DATE '{SPLIT}' THEN 'selection' ELSE 'holdout' END AS evaluation_split FROM walk) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY series_id, evaluation_split ORDER BY origin DESC) <= 40",
    dates=("origin", "target_week"),
)
def v02(spark, sf_dir):
    origins = baselines.split_of(walk(spark, sf_dir).filter("model = 'markov'").select("series_id", "origin", "target_week"), "target_week", SPLIT)
    return baselines.tail_budget(origins, ["series_id", "evaluation_split"], "origin", 40)


@register(
    "v04_split_audit",
    WALK
    + f""", lg AS (SELECT series_id, week, lag(week, 2) {LAG} AS lo, lag(week, 1) {LAG} AS lt FROM lab)
SELECT w.series_id, w.origin, train_size, lo AS last_train_origin, lt AS last_train_target, pos - train_size AS purged
FROM walk w JOIN lg ON w.series_id = lg.series_id AND w.origin = lg.week WHERE model = 'markov'""",
    dates=("origin", "last_train_origin", "last_train_target"),
)
def v04(spark, sf_dir):
    """The last training row of every origin and its target, from the rows of the series."""
    from pyspark.sql import Window

    states = labelled(spark, sf_dir).select("series_id", "week", "state")
    order = Window.partitionBy("series_id").orderBy("week")
    rows = states.select("series_id", F.col("week").alias("origin"), F.lag("week", 2).over(order).alias("last_train_origin"), F.lag("week", 1).over(order).alias("last_train_target"))
    origins = baselines.walk_forward(states, TRAIN_WEEKS).filter("model = 'markov'").select("series_id", "origin", "train_size", (F.col("pos") - F.col("train_size")).alias("purged"))
    return origins.join(rows, ["series_id", "origin"])


_Q = ", ".join(f"least(greatest(p_{s}, 1e-9), 1.0) AS r{i}" for i, s in enumerate(STATES))
PREP = (
    f", pr AS (SELECT *, {_Q} FROM walk), pq AS (SELECT *, r0 / (r0 + r1 + r2) AS q0, r1 / (r0 + r1 + r2) AS q1, r2 / (r0 + r1 + r2) AS q2 FROM pr), "
    "pp AS (SELECT *, greatest(q0, q1, q2) AS top, CASE actual WHEN 'risk_on' THEN q0 WHEN 'transition' THEN q1 ELSE q2 END AS hit, CASE WHEN q0 = greatest(q0, q1, q2) THEN 'risk_on' WHEN q1 = greatest(q0, q1, q2) THEN 'transition' ELSE 'risk_off' END AS predicted FROM pq)"
)


def _rat(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


def _n(test: str) -> str:
    return f"count(*) FILTER ({test})"


_REC = " + ".join(f"coalesce(CASE WHEN {_n(f'actual = $${s}$$')} > 0 THEN {_n(f'actual = $${s}$$ AND predicted = $${s}$$')} / {_n(f'actual = $${s}$$')} END, 0)" for s in STATES)
_PRESENT = " + ".join(f"CASE WHEN {_n(f'actual = $${s}$$')} > 0 THEN 1 ELSE 0 END" for s in STATES)
_F1 = " + ".join("(" + _rat(f"2 * {_n(f'actual = $${s}$$ AND predicted = $${s}$$')}", f"({_n(f'actual = $${s}$$')} + {_n(f'predicted = $${s}$$')})") + ")" for s in STATES)
_BRIER = " + ".join(f"pow(q{i} - CAST(actual = '{s}' AS INT), 2)" for i, s in enumerate(STATES))
ECE = ", bins AS (SELECT series_id, model, greatest(ceil(round(top * 10, 9)), 1) AS b, count(*) AS n, avg(CAST(actual = predicted AS INT)) AS acc, avg(top) AS conf FROM pp GROUP BY 1, 2, 3), ece AS (SELECT series_id, model, sum(n * abs(acc - conf)) / sum(n) AS calibration_error FROM bins GROUP BY 1, 2)"
BOARD = (
    PREP + ECE + f", board AS (SELECT series_id, model, -avg(ln(hit)) AS log_loss, avg({_BRIER}) AS brier, avg(CAST(actual = predicted AS INT)) AS accuracy, ({_REC}) / ({_PRESENT}) AS balanced_accuracy, ({_F1}) / 3 AS macro_f1, "
    + f"{_rat(_n('actual <> current_state AND predicted <> current_state'), _n('predicted <> current_state'))} AS transition_precision, {_rat(_n('actual <> current_state AND predicted <> current_state'), _n('actual <> current_state'))} AS transition_recall, "
    + f"{_rat(_n('actual = $$transition$$ AND predicted = $$transition$$'), _n('predicted = $$transition$$'))} AS transition_state_precision, {_rat(_n('actual = $$transition$$ AND predicted = $$transition$$'), _n('actual = $$transition$$'))} AS transition_state_recall, count(*) AS n_predictions FROM pp GROUP BY 1, 2), full_board AS (SELECT * FROM board JOIN ece USING (series_id, model))"
)
_SCORES = ("log_loss", "brier", "accuracy", "balanced_accuracy", "macro_f1", "transition_precision", "transition_recall", "transition_state_precision", "transition_state_recall", "calibration_error")


@register("v05_v06_v07_leaderboard", WALK + BOARD + " SELECT series_id, model, n_predictions, " + ", ".join(r6(c, c) for c in _SCORES) + " FROM full_board", dates=())
def v05(spark, sf_dir):
    return rounded(metrics.leaderboard(walk(spark, sf_dir), ["series_id", "model"]))


#: The baselines of selection; what else forecasts is a challenger.
BASELINES, COMPLEXITY = ["majority", "persistence", "markov"], {"majority": 0, "persistence": 0, "markov": 0, "class_prior": 1}
_IS_BASE = "model IN ('majority', 'persistence', 'markov')"


@register(
    "v13_select_champion",
    WALK
    + BOARD
    + f""", rb AS (SELECT series_id, model, round(log_loss, 9) AS ll, round(calibration_error, 9) AS ce, CAST(model = 'class_prior' AS INT) AS cx FROM full_board),
base AS (SELECT * FROM rb WHERE {_IS_BASE} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ll, ce, model) = 1),
ok AS (SELECT rb.* FROM rb JOIN base ON rb.series_id = base.series_id WHERE NOT rb.{_IS_BASE} AND rb.ll <= base.ll - 0.001 AND rb.ce <= base.ce + 0.02),
nr AS (SELECT * FROM ok QUALIFY ll <= min(ll) OVER (PARTITION BY series_id) + 0.01),
win AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY cx, ce, ll, model) = 1)
SELECT base.series_id, coalesce(win.model, base.model) AS champion, win.model IS NOT NULL AS beats_baseline FROM base LEFT JOIN win USING (series_id)""",
    dates=(),
)
def v13(spark, sf_dir):
    board = metrics.leaderboard(walk(spark, sf_dir), ["series_id", "model"])
    board = rounded(board, places=9)
    return metrics.select_champion(board, ["series_id"], BASELINES, COMPLEXITY)


@register("v18_regret", WALK + BOARD + " SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY round(log_loss, 9), model) AS rank, " + r6("log_loss - min(log_loss) OVER (PARTITION BY series_id)", "regret") + ", round(log_loss, 9) - min(round(log_loss, 9)) OVER (PARTITION BY series_id) > 0.05 AS weak FROM full_board", dates=())
def v18(spark, sf_dir):
    return rounded(metrics.regret(rounded(metrics.leaderboard(walk(spark, sf_dir), ["series_id", "model"]), places=9), ["series_id"]))


def _haz(h: int) -> str:
    pre = f"OVER (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND {h + 1} PRECEDING)"
    own = ", ".join(f"count(*) FILTER (state = '{s}' AND nxt = '{s}') {pre} AS s{i}, count(*) FILTER (state = '{s}') {pre} AS m{i}" for i, s in enumerate(STATES))
    return f"t{h} AS ({_ahead(h)}), u{h} AS (SELECT *, lead(state) {LAG} AS nxt, CASE WHEN full_ THEN len(other) > 0 END AS ev FROM t{h}), w{h} AS (SELECT *, {own}, count(ev) {pre} AS n, count(*) FILTER (ev) {pre} AS k FROM u{h}), x{h} AS (SELECT *, CASE state WHEN 'risk_on' THEN (s0 + 1) / (m0 + 3) WHEN 'transition' THEN (s1 + 1) / (m1 + 3) ELSE (s2 + 1) / (m2 + 3) END AS stay FROM w{h} WHERE pos >= {TRAIN_WEEKS + h} AND ev IS NOT NULL)"


HAZ = ", " + ", ".join(map(_haz, (1, 4, 13))) + ", haz AS (" + " UNION ALL ".join(f"SELECT series_id, week AS origin, {h} AS horizon, state AS current_state, ev AS actual_change, '{m}' AS model, {e} AS p_change FROM x{h}" for h in (1, 4, 13) for m, e in (("empirical_hazard", "(k + 1) / (n + 2)"), ("markov_hazard", f"1 - pow(stay, {h})"))) + ")"


def hazards(spark, sf_dir):
    return materialize(baselines.hazards(labelled(spark, sf_dir).select("series_id", "week", "state"), TRAIN_WEEKS), "hazards")


@register(
    "v09_comparable",
    BASE + HAZ + " SELECT series_id, origin, count(DISTINCT model || '_' || horizon) AS n_models, count(*) AS n_rows, count(DISTINCT actual_change) AS n_outcomes FROM haz GROUP BY 1, 2 HAVING count(DISTINCT model || '_' || horizon) <> 6 OR count(*) <> 6 OR count(DISTINCT actual_change) <> 1",
    dates=("origin",),
)
def v09(spark, sf_dir):
    """Hazards of all horizons side by side: origins where a horizon is open or not yet trained, or where outcomes differ."""
    named = hazards(spark, sf_dir).withColumns({"model": F.concat_ws("_", "model", "horizon"), "actual": F.col("actual_change")})
    return metrics.comparable(named, ["series_id", "origin"], 6)


@register("t01_t02_hazards", BASE + HAZ + " SELECT series_id, origin, CAST(horizon AS BIGINT) AS horizon, current_state, actual_change, model, " + r6("p_change", "p_change") + " FROM haz", dates=("origin",))
def t01(spark, sf_dir):
    return rounded(hazards(spark, sf_dir))


EV = ", hz AS (SELECT series_id, CAST(horizon AS BIGINT) AS horizon, model, actual_change AS y, round(p_change, 9) AS p FROM haz)"


@register(
    "v08_event_scores",
    BASE + HAZ + EV + " SELECT series_id, horizon, model, " + r6("-avg(CASE WHEN y THEN ln(p) ELSE ln(1 - p) END)", "log_loss") + ", " + r6("avg(pow(p - CAST(y AS INT), 2))", "brier") + ", " + r6(_rat("count(*) FILTER (y AND p >= 0.5)", "count(*) FILTER (p >= 0.5)"), "precision") + ", " + r6(_rat("count(*) FILTER (y AND p >= 0.5)", "count(*) FILTER (y)"), "recall") + ", " + r6("count(*) FILTER (p >= 0.5 AND NOT y) / greatest(count(*) / 52.1775, 1 / 52.1775)", "false_alarms_per_year") + ", count(*) AS n_predictions, count(*) FILTER (y) AS event_count FROM hz GROUP BY 1, 2, 3",
    dates=(),
)
def v08(spark, sf_dir):
    rows = rounded(hazards(spark, sf_dir), places=9)
    return rounded(metrics.event_scores(rows.withColumn("predicted_change", F.col("p_change") >= 0.5), ["series_id", "horizon", "model"]))


@register(
    "v08_average_precision",
    BASE + HAZ + EV + ", tie AS (SELECT series_id, horizon, model, p, count(*) AS n, count(*) FILTER (y) AS k FROM hz GROUP BY 1, 2, 3, 4), cu AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM tie WINDOW w AS (PARTITION BY series_id, horizon, model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT series_id, horizon, model, " + r6("CASE WHEN sum(k) > 0 THEN sum(k * ck / cn) / sum(k) END", "average_precision") + " FROM cu GROUP BY 1, 2, 3",
    dates=(),
)
def v08_ap(spark, sf_dir):
    return rounded(metrics.average_precision(rounded(hazards(spark, sf_dir), places=9), ["series_id", "horizon", "model"]))


@register(
    "t08_best_threshold",
    BASE + HAZ + EV + ", few AS (SELECT series_id, horizon, model, count(*) < 26 OR count(*) FILTER (y) IN (0, count(y)) AS few FROM hz GROUP BY 1, 2, 3), g AS (SELECT series_id, horizon, model, t, " + f"({_rat('count(*) FILTER (y AND p >= t / 100)', 'count(*) FILTER (y)')}) / 2 + ({_rat('count(*) FILTER (NOT y AND p < t / 100)', 'count(*) FILTER (NOT y)')}) / 2 AS score" + " FROM hz, generate_series(5, 95) v(t) GROUP BY 1, 2, 3, 4) SELECT series_id, horizon, model, CASE WHEN few THEN 0.5 ELSE t / 100 END AS threshold, CASE WHEN NOT few THEN round(score, 6) + 0.0 END AS balanced_accuracy FROM g JOIN few USING (series_id, horizon, model) QUALIFY row_number() OVER (PARTITION BY series_id, horizon, model ORDER BY round(score, 10) DESC, abs(t - 50), t DESC) = 1",
    dates=(),
)
def t08(spark, sf_dir):
    found = metrics.best_threshold(rounded(hazards(spark, sf_dir), places=9), ["series_id", "horizon", "model"])
    return rounded(found)


EXPERTS = ["majority", "markov", "class_prior"]
_W52 = "datediff('day', min(target_week) OVER (PARTITION BY series_id), {}) / 7"


@register(
    "m19_dynamic_ensemble",
    WALK + ", ex AS (SELECT *, -ln(least(greatest(CASE actual WHEN 'risk_on' THEN p_risk_on WHEN 'transition' THEN p_transition ELSE p_risk_off END, 1e-12), 1)) AS loss FROM walk WHERE model IN ('majority', 'markov', 'class_prior')), dl AS (SELECT a.series_id, a.origin, a.model, count(b.loss) AS history_rows, coalesce(sum(b.loss * pow(0.5, ((a.origin - b.target_week) / 7) / 52)), 0) AS d FROM ex a LEFT JOIN ex b ON a.series_id = b.series_id AND a.model = b.model AND b.target_week < a.origin GROUP BY 1, 2, 3), rw AS (SELECT *, CASE WHEN history_rows < 26 THEN 1 ELSE exp(min(d) OVER (PARTITION BY series_id, origin) - d) END AS raw FROM dl) SELECT series_id, origin, model, history_rows, history_rows < 26 AS warmup, " + r6("d", "discounted_log_loss") + ", " + r6("raw / sum(raw) OVER (PARTITION BY series_id, origin)", "weight") + " FROM rw",
    dates=("origin",),
)
def m19(spark, sf_dir):
    found = metrics.ensemble_weights(walk(spark, sf_dir).filter(F.col("model").isin(EXPERTS)))
    return rounded(found.select("series_id", "origin", "model", "history_rows", "warmup", "discounted_log_loss", "weight"))


_JOIN = ", mk AS (SELECT w.*, h.p_change FROM walk w JOIN haz h ON w.series_id = h.series_id AND w.origin = h.origin AND h.horizon = 1 AND h.model = 'empirical_hazard' WHERE w.model = 'class_prior')"
_FL = ", ".join(f"CASE WHEN current_state = '{s}' THEN 0 ELSE greatest(p_{s}, 1e-6) END AS f{i}" for i, s in enumerate(STATES))


@register(
    "m18_j03_hazard_destination",
    WALK + HAZ + _JOIN + f", fl AS (SELECT *, {_FL} FROM mk) SELECT series_id, origin, " + ", ".join(r6(f"CASE WHEN current_state = '{s}' THEN 1 - p_change ELSE p_change * f{i} / (f0 + f1 + f2) END", f"j_{s}") for i, s in enumerate(STATES)) + " FROM fl",
    dates=("origin",),
)
def m18(spark, sf_dir):
    prior = walk(spark, sf_dir).filter("model = 'class_prior'")
    hazard = hazards(spark, sf_dir).filter("horizon = 1 AND model = 'empirical_hazard'").select("series_id", "origin", "p_change")
    return rounded(metrics.hazard_destination(prior.join(hazard, ["series_id", "origin"])).select("series_id", "origin", *[f"j_{s}" for s in STATES]))


@register(
    "m17_convex_blend",
    WALK + ", hits AS (SELECT series_id, origin, max(CASE WHEN model = 'markov' THEN h END) AS a, max(CASE WHEN model = 'class_prior' THEN h END) AS b FROM (SELECT *, CASE actual WHEN 'risk_on' THEN p_risk_on WHEN 'transition' THEN p_transition ELSE p_risk_off END AS h FROM walk) GROUP BY 1, 2), g AS (SELECT series_id, k, round(avg(-ln(greatest(k / 1000 * a + (1 - k / 1000) * b, 1e-12))), 10) AS loss FROM hits, generate_series(0, 1000) v(k) GROUP BY 1, 2) SELECT series_id, k / 1000 AS weight, " + r6("loss", "log_loss") + " FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY loss, abs(k - 500), k) = 1",
    dates=(),
)
def m17(spark, sf_dir):
    hit = F.when(F.col("actual") == STATES[0], F.col("p_risk_on")).when(F.col("actual") == STATES[1], F.col("p_transition")).otherwise(F.col("p_risk_off"))
    rows = walk(spark, sf_dir).withColumn("hit", hit)
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("hit")))
    pairs = rows.groupBy("series_id", "origin").agg(of("markov").alias("p_left"), of("class_prior").alias("p_right"))
    return rounded(metrics.convex_blend(pairs, ["series_id"]))


@register(
    "m20_t06_survival",
    BASE + HAZ + " SELECT series_id, origin, CAST(h AS BIGINT) AS horizon, " + r6("1 - pow(1 - p_change, h)", "p_change") + ", " + r6("pow(1 - p_change, h)", "survival") + " FROM haz, (VALUES (1), (4), (13)) v(h) WHERE horizon = 1 AND model = 'empirical_hazard'",
    dates=("origin",),
)
def m20(spark, sf_dir):
    one = hazards(spark, sf_dir).filter("horizon = 1 AND model = 'empirical_hazard'").select("series_id", "origin", F.col("p_change").alias("hazard"))
    return rounded(metrics.survival(one).drop("hazard"))


@register(
    "p08_probability_violations",
    WALK + " SELECT series_id, origin, model FROM walk WHERE abs(" + " + ".join(f"round(p_{s}, 6)" for s in STATES) + " - 1) > 5e-7",
    dates=("origin",),
)
def p08(spark, sf_dir):
    """Forecasts as they are printed, at six digits: those that no longer sum to 1."""
    printed = rounded(walk(spark, sf_dir))
    return metrics.probability_violations(printed, [f"p_{s}" for s in STATES], tolerance=5e-7).select("series_id", "origin", "model")


@register(
    "j04_j05_common_origins",
    WALK + BOARD + ", common AS (SELECT origin FROM walk WHERE model = 'markov' GROUP BY 1 HAVING count(*) = 5) SELECT w.series_id, w.origin, w.model, " + r6("log_loss", "log_loss") + " FROM walk w LEFT JOIN full_board b ON w.series_id = b.series_id AND w.model = b.model WHERE w.origin IN (SELECT origin FROM common)",
    dates=("origin",),
)
def j04(spark, sf_dir):
    rows = walk(spark, sf_dir)
    common = rows.filter("model = 'markov'").groupBy("origin").agg(F.count(F.lit(1)).alias("n")).filter("n = 5")
    board = metrics.leaderboard(rows, ["series_id", "model"]).select("series_id", "model", "log_loss")
    return rounded(rows.join(common, "origin", "left_semi").join(board, ["series_id", "model"], "left").select("series_id", "origin", "model", "log_loss"))


@register(
    "l13_flat_forecasts",
    WALK
    + " SELECT series_id, origin AS origin_date, current_state, "
    + ", ".join(f"CAST(current_state = '{s}' AS DOUBLE) AS current_p_{s}" for s in STATES)
    + ", target_week AS target_date, model, "
    + ", ".join(r6(f"p_{s}", f"next_p_{s}") for s in STATES)
    + ", false AS fallback, '' AS fallback_reason FROM walk",
    dates=("origin_date", "target_date"),
)
def l13(spark, sf_dir):
    """Forecasts nested as they are published, and flattened."""
    rows = walk(spark, sf_dir)
    pairs = lambda values: F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.array(*values))
    now = F.struct(F.col("current_state").alias("state"), pairs([(F.col("current_state") == s).cast("double") for s in STATES]).alias("probabilities"))
    later = F.struct(
        F.col("target_week").alias("date"), "model", F.lit(False).alias("fallback"), F.lit("").alias("fallback_reason"), pairs([F.col(f"p_{s}") for s in STATES]).alias("probabilities")
    )
    nested = rows.select("series_id", F.col("origin").alias("data_as_of"), now.alias("current"), later.alias("next_week"))
    return rounded(labels.flat_forecasts(nested))

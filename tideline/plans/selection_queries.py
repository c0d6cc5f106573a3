"""Selection, nowcast and evidence queries on the weekly order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import baselines, features, labels, metrics, nowcast, selection
from tideline.operators.labels import STATES
from tideline.plans.feature_queries import sql, z
from tideline.plans.forecast_queries import BASE, BASELINES, BOARD, COMPLEXITY, EV, HAZ, PREP, SPLIT, WALK, _fitted, hazards, walk
from tideline.plans.registry import register
from tideline.session import materialize
from tideline.sources.panel import order_panel

@register("l07_duration_filter", dates=())
def l07(spark, sf_dir):
    """Not in SQL: the posterior is a table that every week changes; tests compare it with a cell-by-cell version."""
    return rounded(nowcast.duration_filter(labels.state_probabilities(_fitted(spark, sf_dir))))


def paired_pvalues(forecasts):
    """(series_id, model, p) of every challenger: the bootstrap of its gain over the best baseline of the series."""
    scored = materialize(metrics.prepared(forecasts).select("series_id", "model", "origin", (-F.ln("hit")).alias("loss")), "losses")
    mean = scored.filter(F.col("model").isin(BASELINES)).groupBy("series_id", "model").agg(F.round(F.avg("loss"), 9).alias("mean"))
    best = mean.groupBy("series_id").agg(F.min(F.struct("mean", "model"))["model"].alias("model"))
    base = scored.join(best, ["series_id", "model"]).select("series_id", "origin", F.col("loss").alias("base"))
    paired = scored.filter(~F.col("model").isin(BASELINES)).join(base, ["series_id", "origin"])
    return selection.block_bootstrap(paired.withColumn("improvement", F.col("base") - F.col("loss")), ["series_id"], "model", "origin")


@register("v10_block_bootstrap", dates=())
def v10(spark, sf_dir):
    """Not in SQL: the draws are those of a seeded generator; tests compare it with single resamples."""
    return rounded(paired_pvalues(walk(spark, sf_dir)))


@register("v11_holm", dates=())
def v11(spark, sf_dir):
    """Not in SQL: it adjusts the p-values of v10; tests compare it with a plain loop."""
    return rounded(metrics.holm(paired_pvalues(walk(spark, sf_dir)).select("series_id", "model", "p"), ["series_id"]))


#: The persistence, Markov and class prior forecasts against the majority: a family of three for each series.
_RIVALS = """, ls AS (SELECT series_id, model, origin, -ln(hit) AS loss FROM pp),
im AS (SELECT a.series_id, a.model, a.origin, b.loss - a.loss AS d FROM ls a JOIN ls b ON a.series_id = b.series_id AND a.origin = b.origin AND b.model = 'majority' WHERE a.model <> 'majority'),
bl AS (SELECT series_id, model, (row_number() OVER (PARTITION BY series_id, model ORDER BY origin) - 1) // 13 AS b, d FROM im),
bm AS (SELECT series_id, model, b, round(avg(d), 9) AS m FROM bl GROUP BY 1, 2, 3),
bc AS (SELECT series_id, model, count(*) FILTER (m <> 0) AS blocks, count(*) FILTER (m > 0) AS better FROM bm GROUP BY 1, 2),
pv AS (SELECT series_id, model, blocks, better, list_sum(list_transform(range(better, blocks + 1), lambda i: round(exp(lgamma(blocks + 1) - lgamma(i + 1) - lgamma(blocks - i + 1))))) / pow(2, blocks) AS p FROM bc),
hr AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY series_id) - row_number() OVER (PARTITION BY series_id ORDER BY round(p, 12), model) + 1)) AS raw, row_number() OVER (PARTITION BY series_id ORDER BY round(p, 12), model) AS k FROM pv),
hm AS (SELECT series_id, model, blocks, better, p, max(raw) OVER (PARTITION BY series_id ORDER BY k) AS p_holm FROM hr)"""


def _rivals(spark, sf_dir):
    """The forecasts, and (series_id, model, blocks, better, p) of the three challengers of the majority."""
    forecasts = walk(spark, sf_dir)
    losses = materialize(metrics.prepared(forecasts).select("series_id", "model", "origin", (-F.ln("hit")).alias("loss")), "losses")
    base = losses.filter("model = 'majority'").select("series_id", "origin", F.col("loss").alias("base"))
    paired = losses.filter("model <> 'majority'").join(base, ["series_id", "origin"]).withColumn("improvement", F.col("base") - F.col("loss"))
    return forecasts, rounded(selection.block_sign_test(paired, ["series_id"], "model", "origin"), places=12)


@register(
    "v11_holm_sign_test",
    WALK + PREP + _RIVALS + " SELECT series_id, model, blocks, better, round(p, 6) + 0.0 AS p, round(p_holm, 6) + 0.0 AS p_holm FROM hm",
    dates=(),
)
def v11_sign(spark, sf_dir):
    return rounded(metrics.holm(_rivals(spark, sf_dir)[1], ["series_id"]))


@register(
    "v12_gated_rivals",
    WALK
    + BOARD
    + _RIVALS
    + """, rb AS (SELECT series_id, model, round(log_loss, 9) AS ll, round(brier, 9) AS br, round(calibration_error, 9) AS ce FROM full_board),
rf AS (SELECT * FROM rb WHERE model = 'majority'),
gt AS (SELECT rb.*, p_holm, CASE WHEN rf.ll - rb.ll < 0.05 THEN 'gain' WHEN p_holm > 0.05 THEN 'p_value' WHEN rb.br > rf.br + 0.01 THEN 'brier' ELSE 'passed' END AS gate_reason
 FROM rb JOIN rf USING (series_id) JOIN hm ON hm.series_id = rb.series_id AND hm.model = rb.model),
nr AS (SELECT series_id, model FROM (SELECT *, min(ll) OVER (PARTITION BY series_id) AS best FROM gt WHERE gate_reason = 'passed') WHERE ll <= best + 0.01
 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY CAST(model = 'class_prior' AS INT), ce, ll, model) = 1)
SELECT gt.series_id, gt.model, 'majority' AS reference, round(p_holm, 6) + 0.0 AS p_holm, gate_reason, nr.model IS NOT NULL AS selected FROM gt LEFT JOIN nr ON nr.series_id = gt.series_id AND nr.model = gt.model""",
    dates=(),
)
def v12_rivals(spark, sf_dir):
    forecasts, pvalues = _rivals(spark, sf_dir)
    board = materialize(rounded(metrics.leaderboard(forecasts, ["series_id", "model"]), places=9), "rivals")
    return rounded(selection.gated_champion(board, pvalues.select("series_id", "model", "p"), ["series_id"], ["majority"], COMPLEXITY))


_EVENTS = """, esc AS (SELECT series_id, horizon, model, round(round(-avg(CASE WHEN y THEN ln(p) ELSE ln(1 - p) END), 6), 6) AS ll, round(avg(pow(p - CAST(y AS INT), 2)), 6) AS br FROM hz WHERE y IS NOT NULL GROUP BY 1, 2, 3),
eb AS (SELECT * FROM esc WHERE model = 'empirical_hazard'), ew AS (SELECT esc.* FROM esc JOIN eb USING (series_id, horizon) WHERE esc.model <> 'empirical_hazard' AND esc.ll <= eb.ll - 0.005 AND esc.br <= eb.br + 0.005),
champ AS (SELECT eb.series_id, eb.horizon, coalesce(ew.model, eb.model) AS champion, ew.model IS NOT NULL AS beats_baseline FROM eb LEFT JOIN ew USING (series_id, horizon))"""


def _event_champions(scored):
    known = scored.filter("actual_change IS NOT NULL").withColumn("predicted_change", F.col("p_change") >= 0.5)
    board = materialize(rounded(metrics.event_scores(known, ["series_id", "horizon", "model"])), "event-board")
    return selection.event_champion(board, ["series_id", "horizon"], ["empirical_hazard"], {"empirical_hazard": 0, "markov_hazard": 1})


@register("t10_event_champion", BASE + HAZ + EV + _EVENTS + " SELECT series_id, CAST(horizon AS BIGINT) AS horizon, champion, beats_baseline FROM champ", dates=())
def t10(spark, sf_dir):
    rows = rounded(hazards(spark, sf_dir), places=9)
    return _event_champions(rows).withColumn("horizon", F.col("horizon").cast("long"))


@register(
    "v19_risk_history",
    BASE + HAZ + EV + _EVENTS + f""", own AS (SELECT h.series_id, h.origin, h.horizon, round(round(h.p_change, 9), 6) AS p FROM haz h JOIN champ c ON h.series_id = c.series_id AND h.horizon = c.horizon AND h.model = c.champion
 WHERE h.origin >= DATE '{SPLIT}' OR h.actual_change IS NULL)
SELECT series_id, origin, max(p) FILTER (horizon = 1) AS risk_1w, max(p) FILTER (horizon = 4) AS risk_4w, max(p) FILTER (horizon = 13) AS risk_13w FROM own GROUP BY 1, 2""",
    dates=("origin",),
)
def v19(spark, sf_dir):
    rows = rounded(hazards(spark, sf_dir), places=9)
    scored = rows.filter(f"origin >= DATE '{SPLIT}' AND actual_change IS NOT NULL")
    history = selection.risk_history(scored, rows.filter("actual_change IS NULL"), _event_champions(rows), ["series_id"])
    return rounded(history.select("series_id", "origin", *[F.element_at("risks", h).alias(f"risk_{h}w") for h in (1, 4, 13)]))


_ADVERSE = ["1-URGENT", "2-HIGH"]


@register(
    "v21_evidence_drivers",
    sql(
        ", zz AS (SELECT series_id AS feature, week, round(" + z("price", 52) + """, 9) AS v FROM panel),
rk AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY abs(v) DESC, feature) AS place, CASE WHEN feature IN ('1-URGENT', '2-HIGH') THEN -v ELSE v END AS i FROM zz WHERE v IS NOT NULL)
SELECT week, feature, place, round(v, 4) AS value, round(greatest(-4.0, least(4.0, i)), 4) AS impact, CASE WHEN i >= 0 THEN 'risk_on' ELSE 'risk_off' END AS direction FROM rk WHERE place <= 3"""
    ),
)
def v21(spark, sf_dir):
    scores = rounded(features.macro_z(order_panel(spark, sf_dir)), places=9).select("week", F.col("series_id").alias("feature"), F.col("z_52w").alias("value"))
    found = selection.evidence_drivers(scores, ["week"], _ADVERSE, limit=3)
    return found.withColumn("place", F.col("place").cast("long"))

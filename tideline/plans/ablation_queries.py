"""Feature ablation over the order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import ablation, baselines, discriminant
from tideline.operators.labels import STRESS, TREND
from tideline.plans.feature_queries import r6
from tideline.plans.forecast_queries import _BRIER, PREP, SPLIT, TRAIN_WEEKS, WALK, walk
from tideline.plans.learned_queries import _inputs
from tideline.plans.registry import register
from tideline.session import materialize

GROUPS = {"trend": list(TREND), "stress": list(STRESS), "scores": ["trend_score", "stress_score", "risk_score"]}
_BY = "series_id, model, sp"


@register(
    "v17_ablation_scores",
    WALK
    + PREP
    + f""", vv AS (SELECT *, CASE WHEN target_week < DATE '{SPLIT}' THEN 'selection' ELSE 'holdout' END AS sp, {_BRIER} AS br, -ln(hit) AS ll FROM pp),
vd AS (SELECT a.*, a.ll - b.ll AS dl, a.br - b.br AS db FROM vv a JOIN vv b ON a.series_id = b.series_id AND a.origin = b.origin AND b.model = 'class_prior'),
vb AS (SELECT {_BY}, greatest(ceil(round(top * 10, 9)), 1) AS b, count(*) AS n, avg(CAST(actual = predicted AS INT)) AS acc, avg(top) AS conf FROM vv GROUP BY ALL),
ve AS (SELECT {_BY}, sum(n * abs(acc - conf)) / sum(n) AS ce FROM vb GROUP BY ALL),
vm AS (SELECT {_BY}, avg(ll) AS ll, avg(br) AS br, avg(CAST(actual = predicted AS INT)) AS acc, count(*) AS n, avg(dl) AS dl, avg(db) AS db FROM vd GROUP BY ALL),
va AS (SELECT * FROM vm JOIN ve USING ({_BY})),
vr AS (SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY round(ll, 9), round(br, 9), round(ce, 9), model) AS rk FROM va WHERE sp = 'selection')
SELECT series_id, model AS variant, sp AS evaluation_split, {r6('ll', 'log_loss')}, {r6('br', 'brier')}, {r6('acc', 'accuracy')}, n AS paired_n, {r6('dl', 'log_loss_delta')}, {r6('db', 'brier_delta')}, 0 AS fallback_count, {r6('ce', 'calibration_error')},
 rk AS selection_rank, rk = 1 AS selection_winner FROM va JOIN vr USING (series_id, model)""",
    dates=(),
)
def v17_scores(spark, sf_dir):
    """The scoring part, with the baselines as variants and the class prior as anchor."""
    rows = baselines.split_of(walk(spark, sf_dir), "target_week", SPLIT).withColumnRenamed("model", "variant")
    return rounded(ablation.leaderboard(rows, ["series_id"], "class_prior", 4))


@register("v17_feature_ablation", dates=())
def v17(spark, sf_dir):
    """The discriminant over the trend columns, with each further group, and over all; not in SQL, as its fits are not."""
    variants = ablation.variants_of(GROUPS, "trend", ["trend"], {"stress": ["stress"], "scores": ["scores"]})
    forecasts = ablation.fan_out(_inputs(spark, sf_dir), variants, lambda frame, columns: discriminant.walk_forward(frame, columns, TRAIN_WEEKS))
    rows = materialize(baselines.split_of(forecasts, "target_week", SPLIT), "ablation")
    return rounded(ablation.leaderboard(rows, ["series_id"], "trend", len(variants)))

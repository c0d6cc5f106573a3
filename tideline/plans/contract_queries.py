"""The contract of published weeks, over forecasts of the order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.numeric import rounded
from tideline.operators import contract
from tideline.operators.labels import STATES
from tideline.plans.forecast_queries import HAZ, WALK, _fitted, hazards, walk
from tideline.plans.registry import register
from tideline.session import materialize

SCORES = ["trend_score", "stress_score", "risk_score"]


def _published(spark, sf_dir):
    """Weeks as they are published: Markov forecasts of the next week, hazards of the longer horizons, and the scores."""
    rows = rounded(walk(spark, sf_dir), places=9).filter("model = 'markov'")
    pairs = lambda values: F.map_from_arrays(F.array(*[F.lit(s) for s in STATES]), F.array(*values))
    p = [F.col(f"p_{s}") for s in STATES]
    top = F.greatest(*p)
    likely = F.when(p[0] == top, STATES[0]).when(p[1] == top, STATES[1]).otherwise(STATES[2])
    weeks = rows.select(
        "series_id",
        F.col("origin").alias("date"),
        F.struct(F.col("current_state").alias("state"), pairs([(F.col("current_state") == s).cast("double") for s in STATES]).alias("probabilities")).alias("current"),
        F.struct(F.col("target_week").alias("date"), likely.alias("state"), pairs(p).alias("probabilities")).alias("next_week"),
        (1 - F.element_at(pairs(p), F.col("current_state"))).alias("transition_probability"),
    )
    one = F.when(F.col("horizon") == 1, F.col("model") == "markov_hazard").otherwise(F.col("model") == "empirical_hazard")
    risk = F.struct(
        F.col("p_change").alias("probability"), F.date_add("origin", (7 * F.col("horizon")).cast("int")).alias("target_end"), "model", F.lit(0.5).alias("threshold"),
        F.lit(False).alias("fallback"), F.lit("").alias("fallback_reason"),
    )
    entry = F.struct(F.concat(F.col("horizon").cast("string"), F.lit("w")).alias("key"), risk.alias("value"))
    risks = rounded(hazards(spark, sf_dir), places=9).filter(one).groupBy("series_id", F.col("origin").alias("date")).agg(F.map_from_entries(F.collect_list(entry)).alias("transition_risk"))
    scores = _fitted(spark, sf_dir).select("series_id", F.col("week").alias("date"), F.map_from_arrays(F.array(*map(F.lit, SCORES)), F.array(*[F.round(c, 6) for c in SCORES])).alias("scores"))
    joined = weeks.join(risks, ["series_id", "date"], "left").join(scores, ["series_id", "date"], "left")
    return materialize(contract.with_previous(joined, ["series_id"], ["date"]), "published-weeks")


_P = [f"round(p_{s}, 9)" for s in STATES]
_STAY = "CASE current_state WHEN 'risk_on' THEN {} WHEN 'transition' THEN {} ELSE {} END".format(*_P)
_IN = "({0}) IS NOT NULL AND ({0}) BETWEEN 0 AND 1"


def _risk_sql(h: int) -> list[tuple[str, str]]:
    has = f"r{h} IS NOT NULL"
    return [(f"transition_risk.{h}w.{n}", has) for n in ("probability", "threshold", "model", "fallback", "fallback_reason", "target_end")]


#: Name and condition of every rule, in DuckDB's words.
_CHECKS = [
    ("date.increasing", "origin IS NOT NULL AND (prev IS NULL OR origin > prev)"),
    ("current.state", "current_state IN ('risk_on', 'transition', 'risk_off')"),
    *[(f"current.probabilities.{n}", "true") for n in ("keys", "finite", "range", "sum")],
    ("next_week.state", "true"),
    *[(f"next_week.probabilities.{n}", "true") for n in ("keys", "finite", "range")],
    ("next_week.probabilities.sum", f"abs({' + '.join(_P)} - 1) <= 1e-5"),
    ("transition_probability", _IN.format(f"1 - {_STAY}")),
    *[(f"scores.{s}", f"{s} IS NOT NULL AND round({s}, 6) BETWEEN -1.000001 AND 1.000001") for s in SCORES],
    ("transition_risk.keys", "r1 IS NOT NULL AND r4 IS NOT NULL AND r13 IS NOT NULL"),
    *[c for h in (1, 4, 13) for c in _risk_sql(h)],
    ("alias.transition_probability", f"abs(1 - {_STAY} - r1) <= 1e-8"),
    ("alias.departure", f"abs(r1 - (1 - {_STAY})) <= 1e-8"),
    ("alias.next_week_date", "r1 IS NOT NULL AND target_week = origin + 7"),
]
_WEEKS = (
    WALK
    + HAZ
    + """, rk AS (SELECT series_id, origin, max(round(p_change, 9)) FILTER (horizon = 1 AND model = 'markov_hazard') AS r1, max(round(p_change, 9)) FILTER (horizon = 4 AND model = 'empirical_hazard') AS r4,
 max(round(p_change, 9)) FILTER (horizon = 13 AND model = 'empirical_hazard') AS r13 FROM haz GROUP BY 1, 2),
pw AS (SELECT w.*, r1, r4, r13, trend_score, stress_score, risk_score, lag(w.origin) OVER (PARTITION BY w.series_id ORDER BY w.origin) AS prev
 FROM walk w LEFT JOIN rk USING (series_id, origin) LEFT JOIN lab ON lab.series_id = w.series_id AND lab.week = w.origin WHERE model = 'markov')"""
)


@register(
    "p09_contract_violations",
    _WEEKS + ", bad AS (" + " UNION ALL ".join(f"SELECT series_id, origin AS date, '{n}' AS rule FROM pw WHERE NOT coalesce({c}, false)" for n, c in _CHECKS) + ") SELECT * FROM bad",
    dates=("date",),
)
def p09(spark, sf_dir):
    return contract.violations(_published(spark, sf_dir), ["series_id", "date"], contract.weekly_rules(SCORES))


@register(
    "p09_contract_counts",
    _WEEKS + " " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT coalesce({c}, false)) AS n_violations FROM pw" for n, c in _CHECKS),
    dates=(),
)
def p09_counts(spark, sf_dir):
    return contract.counts(_published(spark, sf_dir), contract.weekly_rules(SCORES))

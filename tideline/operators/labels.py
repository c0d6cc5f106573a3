"""Causal three-state labels: robust scores, a hysteresis state machine and soft state probabilities, per series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numeric import TINY, lag, positive_log, rolling, safe_divide
from tideline.session import materialize

STATES = ("risk_on", "transition", "risk_off")
TREND, STRESS = ("trend_13w", "trend_26w"), ("vol_4w", "vol_13w", "drawdown_13w", "drawdown_52w")
SCORE_PLACES = 8  # scores are rounded before they meet a threshold, so that engines agree on states


def components(panel: DataFrame) -> DataFrame:
    """Trend, volatility and drawdown with the label's own minimum periods."""
    p = panel.withColumn("lnp", positive_log(F.col("price"))).withColumn("r", F.col("lnp") - lag("lnp", 1))
    out = {}
    for n in (13, 26):
        out[f"trend_{n}w"] = safe_divide(F.col("lnp") - lag("lnp", n), rolling(F.stddev_pop, F.col("r"), n, max(4, n // 2)) * math.sqrt(n))
    for n in (4, 13):
        out[f"vol_{n}w"] = rolling(F.stddev_pop, F.col("r"), n, max(2, n // 2)) * math.sqrt(52)
    for n in (13, 52):
        out[f"drawdown_{n}w"] = 1 - F.col("price") / rolling(F.max, F.col("price"), n, max(4, n // 2))
    return p.withColumns(out)


def robust_stats(frame: DataFrame, columns: tuple[str, ...], key: str = "series_id") -> DataFrame:
    """Per series median and scale (IQR / 1.349, else 1.4826 MAD, else 1) of each column."""
    middle = frame.groupBy(key).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}") for c in columns])
    spread = frame.join(middle, key).groupBy(key).agg(*[F.median(F.abs(F.col(c) - F.col(f"_{c}")[1])).alias(f"_mad_{c}") for c in columns])
    out = [key]
    for c in columns:
        q, mad = F.col(f"_{c}"), F.col(f"_mad_{c}") * 1.4826
        iqr = (q[2] - q[0]) / 1.349
        out += [q[1].alias(f"{c}_centre"), F.when(iqr > TINY, iqr).when(mad > TINY, mad).otherwise(1.0).alias(f"{c}_scale")]
    return middle.join(spread, key).select(out)


def _mean_of(columns: tuple[str, ...]) -> Column:
    known = sum(F.col(c).isNotNull().cast("int") for c in columns)
    return F.when(known > 0, sum(F.coalesce(F.col(c), F.lit(0.0)) for c in columns) / known)


def _standard(c: str) -> Column:
    return (F.col(c) - F.col(f"{c}_centre")) / F.col(f"{c}_scale")


def fitted(panel: DataFrame, train_weeks: int, lower: float = 0.3, upper: float = 0.7) -> dict[str, DataFrame]:
    """The label model of the first weeks of every series, and the scores of all weeks.

    ``parts`` and ``whole`` hold centre and scale of the components and of the composites, ``limits`` the thresholds,
    ``scores`` (series_id, week, trend_score, stress_score, risk_score, lower, upper). Each step is written, so that the
    next one reads it instead of the panel. The statistics have a row per series and are joined by series.
    """
    position = F.row_number().over(Window.partitionBy("series_id").orderBy("week"))
    frame = materialize(components(panel).withColumn("_n", position), "label-components")
    parts = materialize(robust_stats(frame.filter(F.col("_n") <= train_weeks), TREND + STRESS), "label-parts")
    joined = frame.join(parts, "series_id").withColumns({f"z_{c}": _standard(c) for c in TREND + STRESS})
    means = {"trend_raw": _mean_of(tuple(f"z_{c}" for c in TREND)), "stress_raw": _mean_of(tuple(f"z_{c}" for c in STRESS))}
    raw = materialize(joined.withColumns(means).select("series_id", "week", "_n", "trend_raw", "stress_raw"), "label-composites")
    whole = materialize(robust_stats(raw.filter(F.col("_n") <= train_weeks), ("trend_raw", "stress_raw")), "label-whole")
    scored = raw.join(whole, "series_id").withColumns({"trend_score": _standard("trend_raw"), "stress_score": _standard("stress_raw")})
    scored = materialize(scored.select("series_id", "week", "_n", "trend_score", "stress_score"), "label-scores")
    risk = F.col("trend_score") - F.col("stress_score")
    limits = scored.filter(F.col("_n") <= train_weeks).groupBy("series_id").agg(
        *[F.round(F.percentile(risk, share), SCORE_PLACES).alias(name) for name, share in (("lower", lower), ("upper", upper))]
    )
    limits = materialize(limits, "label-limits")
    scores = scored.join(limits, "series_id").select("series_id", "week", "trend_score", "stress_score", F.round(risk, SCORE_PLACES).alias("risk_score"), "lower", "upper")
    return {"parts": parts, "whole": whole, "limits": limits, "scores": scores}


def label(scored: DataFrame, hysteresis: float = 0.15, start: str = "transition") -> DataFrame:
    """The state machine, folded over each series' weeks in order; a missing score keeps the state."""
    rows = scored.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("week", "risk_score", "lower", "upper"))).alias("rows"))
    lit = lambda k: F.lit(STATES[k])

    def step(acc: Column, row: Column) -> Column:
        v, low, high = row["risk_score"], row["lower"], row["upper"]
        margin = (high - low) * hysteresis
        before = acc["state"]
        after = (
            F.when(v.isNull(), before)
            .when(before == STATES[1], F.when(v <= low, lit(2)).when(v >= high, lit(0)).otherwise(before))
            .when(before == STATES[0], F.when(v <= low - margin, lit(2)).when(v < high - margin, lit(1)).otherwise(before))
            .otherwise(F.when(v >= high + margin, lit(0)).when(v > low + margin, lit(1)).otherwise(before))
        )
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(after)).alias("out"))

    first = F.struct(F.lit(start).alias("state"), F.array().cast("array<string>").alias("out"))
    states = F.aggregate("rows", first, step)["out"]
    return rows.select("series_id", F.inline(F.zip_with("rows", states, lambda r, s: F.struct(r["week"].alias("week"), r["risk_score"].alias("risk_score"), r["lower"].alias("lower"), r["upper"].alias("upper"), s.alias("state")))))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    raw = [F.exp(x - top) for x in logits]
    return [x / (raw[0] + raw[1] + raw[2]) for x in raw]


def state_probabilities(scored: DataFrame, temperature: float = 0.75) -> DataFrame:
    """Soft membership of the three states by squared distance to their anchors."""
    v, low, high = F.col("risk_score"), F.col("lower"), F.col("upper")
    width = F.greatest(high - low, F.lit(1e-6))
    anchors = [high + width / 2, (low + high) / 2, low - width / 2]
    missing = [-20.0, 0.0, -20.0]
    logits = [F.coalesce(-F.pow((v - a) / width, 2) / temperature, F.lit(m)) for a, m in zip(anchors, missing, strict=True)]
    return scored.select("series_id", "week", *[p.alias(f"p_{s}") for p, s in zip(softmax(logits), STATES, strict=True)])


def estimate(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Clip, normalise (uniform without mass), round to 8 places, first largest state, entropy over ln 3."""
    clipped = [F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns]
    total = clipped[0] + clipped[1] + clipped[2]
    p = [F.round(F.when(total > 0, c / total).otherwise(1 / 3), 8) for c in clipped]
    out = frame.withColumns({f"e_{s}": x for s, x in zip(STATES, p, strict=True)})
    e = [F.col(f"e_{s}") for s in STATES]
    top = F.greatest(*e)
    entropy = -sum(F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in e) / math.log(3)
    return out.withColumns({"state": F.when(e[0] == top, STATES[0]).when(e[1] == top, STATES[1]).otherwise(STATES[2]), "confidence": top, "entropy": entropy})


def align(frame: DataFrame, columns: dict[str, str], floor: float = 1e-9) -> DataFrame:
    """p_<state> in the fixed order from the columns of the classes a model knows; absent classes get the floor."""
    raw = [F.greatest(F.coalesce(F.col(columns[s]), F.lit(0.0)), F.lit(floor)) if s in columns else F.lit(floor) for s in STATES]
    return frame.withColumns({f"p_{s}": x / (raw[0] + raw[1] + raw[2]) for s, x in zip(STATES, raw, strict=True)})


def transition_targets(states: DataFrame, horizon: int) -> DataFrame:
    """Whether the state is left within the next weeks, and the first other state; NULL where the horizon is not over."""
    order = Window.partitionBy("series_id").orderBy("week")
    ahead = order.rowsBetween(1, horizon)
    other = F.filter(F.collect_list("state").over(ahead), lambda s: s != F.col("state"))
    full = F.count("state").over(ahead) == horizon
    return states.withColumn("_other", other).withColumn("_full", full).select(
        "series_id", "week", "state", F.when(F.col("_full"), F.size("_other") > 0).alias("event"), F.when(F.col("_full"), F.coalesce(F.get("_other", F.lit(0)), F.col("state"))).alias("destination")
    )


def label_history(labelled: DataFrame) -> DataFrame:
    """Evidence rows: state, previous state, change flag and thresholds."""
    before = F.lag("state").over(Window.partitionBy("series_id").orderBy("week"))
    return labelled.select("series_id", "week", "state", before.alias("previous_state"), F.coalesce(before != F.col("state"), F.lit(False)).alias("changed"), "risk_score", "lower", "upper")


def flat_forecasts(weeks: DataFrame) -> DataFrame:
    """Flat rows of nested weeks (data_as_of, current, next_week): the states and probabilities now and of the next week.

    ``current`` is a struct of state and a map of probabilities, ``next_week`` one of date, model, fallback,
    fallback_reason and such a map. A missing probability is NULL.
    """
    others = [c for c in weeks.columns if c not in ("data_as_of", "current", "next_week")]
    p = lambda part, name: [F.element_at(F.col(f"{part}.probabilities"), s).alias(f"{name}_p_{s}") for s in STATES]
    return weeks.select(
        *others, F.col("data_as_of").alias("origin_date"), F.col("current.state").alias("current_state"), *p("current", "current"),
        F.col("next_week.date").alias("target_date"), F.col("next_week.model").alias("model"), *p("next_week", "next"),
        F.col("next_week.fallback").alias("fallback"), F.col("next_week.fallback_reason").alias("fallback_reason"),
    )

"""Forecast metrics and selection rules as aggregates over long prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.labels import STATES

P = [f"p_{s}" for s in STATES]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def prepared(predictions: DataFrame) -> DataFrame:
    """Clipped, renormalised probabilities with the predicted state and the probability of what happened."""
    clipped = [F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1.0)) for c in P]
    total = clipped[0] + clipped[1] + clipped[2]
    p = predictions.withColumns({f"q{i}": x / total for i, x in enumerate(clipped)})
    q = [F.col(f"q{i}") for i in range(3)]
    top = F.greatest(*q)
    hit = F.when(F.col("actual") == STATES[0], q[0]).when(F.col("actual") == STATES[1], q[1]).otherwise(q[2])
    return p.withColumns({"top": top, "hit": hit, "predicted": F.when(q[0] == top, STATES[0]).when(q[1] == top, STATES[1]).otherwise(STATES[2])})


def brier_term() -> Column:
    return sum(F.pow(F.col(f"q{i}") - (F.col("actual") == s).cast("double"), 2) for i, s in enumerate(STATES))


def calibration_error(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Top-label expected calibration error; the first bin is closed, the others open at the left."""
    place = F.greatest(F.ceil(F.round(F.col("top") * bins, 9)), F.lit(1))
    per_bin = rows.groupBy(*keys, place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("acc"), F.avg("top").alias("conf")
    )
    return per_bin.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("calibration_error"))


def leaderboard(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of every key; with a column ``fallback`` also fallback_count, the forecasts that fell back."""
    rows = prepared(predictions)
    fell = [F.count(F.when(F.col("fallback"), 1)).alias("fallback_count")] if "fallback" in predictions.columns else []
    a, p, now = F.col("actual"), F.col("predicted"), F.col("current_state")
    recall = [F.when(_count(a == s) > 0, _count((a == s) & (p == s)) / _count(a == s)) for s in STATES]
    f1 = [_ratio(2 * _count((a == s) & (p == s)), _count(a == s) + _count(p == s)) for s in STATES]
    present = sum(F.when(_count(a == s) > 0, 1).otherwise(0) for s in STATES)
    left_a, left_p = a != now, p != now
    mid_a, mid_p = a == STATES[1], p == STATES[1]
    scores = rows.groupBy(*keys).agg(
        (-F.avg(F.ln("hit"))).alias("log_loss"), F.avg(brier_term()).alias("brier"), F.avg((a == p).cast("double")).alias("accuracy"),
        (sum(F.coalesce(x, F.lit(0.0)) for x in recall) / present).alias("balanced_accuracy"), (sum(f1) / 3).alias("macro_f1"),
        _ratio(_count(left_a & left_p), _count(left_p)).alias("transition_precision"), _ratio(_count(left_a & left_p), _count(left_a)).alias("transition_recall"),
        _ratio(_count(mid_a & mid_p), _count(mid_p)).alias("transition_state_precision"), _ratio(_count(mid_a & mid_p), _count(mid_a)).alias("transition_state_recall"),
        F.count(F.lit(1)).alias("n_predictions"), *fell,
    )
    return scores.join(calibration_error(rows, keys), keys)


def event_scores(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Binary scores of (actual_change, p_change, predicted_change)."""
    y, p, hat = F.col("actual_change"), F.col("p_change"), F.col("predicted_change")
    return predictions.groupBy(*keys).agg(
        (-F.avg(F.when(y, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"), F.avg(F.pow(p - y.cast("double"), 2)).alias("brier"),
        _ratio(_count(y & hat), _count(hat)).alias("precision"), _ratio(_count(y & hat), _count(y)).alias("recall"),
        (_count(hat & ~y) / F.greatest(F.count(F.lit(1)) / 52.1775, F.lit(1 / 52.1775))).alias("false_alarms_per_year"),
        F.count(F.lit(1)).alias("n_predictions"), _count(y).alias("event_count"),
    )


def average_precision(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision-recall steps over distinct scores; NULL without events."""
    tied = predictions.groupBy(*keys, "p_change").agg(F.count(F.lit(1)).alias("n"), _count(F.col("actual_change")).alias("k"))
    order = Window.partitionBy(*keys).orderBy(F.col("p_change").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = tied.withColumns({"cn": F.sum("n").over(order), "ck": F.sum("k").over(order)})
    return steps.groupBy(*keys).agg(F.when(F.sum("k") > 0, F.sum(F.col("k") * F.col("ck") / F.col("cn")) / F.sum("k")).alias("average_precision"))


def best_threshold(predictions: DataFrame, keys: list[str], least: int = 26) -> DataFrame:
    """Threshold of .05, .06, ... .95 with the best balanced accuracy; ties go to the nearest to .5, then the larger.

    With fewer than ``least`` rows, or events in all or none of them, the threshold is .5 and its score NULL. The grid
    has 91 values, so the rows are scored once per value without a join.
    """
    y, p = F.col("actual_change"), F.col("p_change")
    scored = predictions.select(*keys, y.alias("y"), p.alias("p"), F.explode(F.sequence(F.lit(5), F.lit(95))).alias("t")).groupBy(*keys, "t").agg(
        (_ratio(_count(F.col("y") & (F.col("p") >= F.col("t") / 100)), _count(F.col("y"))) / 2 + _ratio(_count(~F.col("y") & (F.col("p") < F.col("t") / 100)), _count(~F.col("y"))) / 2).alias("score"),
        ((F.count(F.lit(1)) < least) | (_count(F.col("y")) == 0) | (_count(~F.col("y")) == 0)).alias("few"),
    )
    best = F.max(F.struct(F.round("score", 10).alias("score"), (-F.abs(F.col("t") - 50)).alias("near"), F.col("t"))).alias("b")
    found = scored.groupBy(*keys).agg(best, F.max("few").alias("few"))
    return found.select(*keys, F.when(F.col("few"), 0.5).otherwise(F.col("b.t") / 100).alias("threshold"), F.when(~F.col("few"), F.col("b.score")).alias("balanced_accuracy"))


def holm(pvalues: DataFrame, keys: list[str]) -> DataFrame:
    """Holm-adjusted p-values of (keys, model, p): running maximum of p * (m - rank), at most 1; ties by name."""
    order = Window.partitionBy(*keys).orderBy("p", "model")
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = F.least(F.lit(1.0), F.col("p") * (m - F.row_number().over(order) + 1))
    return pvalues.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def comparable(predictions: DataFrame, keys: list[str], models: int) -> DataFrame:
    """Origins at which not all models forecast, or the outcome differs; empty if the models can be compared."""
    seen = predictions.groupBy(*keys).agg(F.countDistinct("model").alias("n_models"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("actual").alias("n_outcomes"))
    return seen.filter((F.col("n_models") != models) | (F.col("n_rows") != models) | (F.col("n_outcomes") != 1))


def select_champion(board: DataFrame, keys: list[str], baselines: list[str], complexity: dict[str, int], gain: float = 0.001, ece: float = 0.02, near: float = 0.01) -> DataFrame:
    """The simplest candidate within ``near`` of the best that beats the best baseline; else that baseline.

    Where the board has fallback_count, a candidate that fell back is none.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in complexity.items() for x in kv]), F.col("model")), F.lit(99))
    rows = board.withColumns({"rank": rank, "is_base": F.col("model").isin(baselines)})
    if "fallback_count" in board.columns:
        rows = rows.filter(F.col("is_base") | (F.col("fallback_count") == 0))
    best_base = rows.filter("is_base").groupBy(*keys).agg(F.min(F.struct("log_loss", "calibration_error", "model")).alias("base"))
    passed = rows.filter("NOT is_base").join(best_base, keys).filter(
        (F.col("log_loss") <= F.col("base.log_loss") - gain) & (F.col("calibration_error") <= F.col("base.calibration_error") + ece)
    )
    passed = passed.withColumn("_best", F.min("log_loss").over(Window.partitionBy(*keys))).filter(F.col("log_loss") <= F.col("_best") + near)
    winner = passed.groupBy(*keys).agg(F.min(F.struct("rank", "calibration_error", "log_loss", "model")).alias("w"))
    return best_base.join(winner, keys, "left").select(*keys, F.coalesce("w.model", "base.model").alias("champion"), F.col("w").isNotNull().alias("beats_baseline"))


def regret(board: DataFrame, keys: list[str], weak: float = 0.05) -> DataFrame:
    """Rank by log loss and regret against the best model of the split."""
    order = Window.partitionBy(*keys).orderBy("log_loss", "model")
    best = F.min("log_loss").over(Window.partitionBy(*keys))
    return board.select(*keys, "model", F.row_number().over(order).cast("long").alias("rank"), (F.col("log_loss") - best).alias("regret"), (F.col("log_loss") - best > weak).alias("weak"))


def ensemble_weights(history: DataFrame, key: str = "series_id", half_life: float = 52.0, least: int = 26) -> DataFrame:
    """Softmax weights of (key, model, origin, target_week, actual, p_*) experts by discounted past log loss.

    The loss of a forecast fades by half every ``half_life`` weeks after its target. A sum with fading weights is a
    plain sum of ln loss * 2**(target / half life), scaled at the origin, so it is one cumulative frame and no join of
    origins with their past. Only targets strictly before the origin count: on weekly rows, all but the row before.
    """
    hit = F.when(F.col("actual") == STATES[0], F.col(P[0])).when(F.col("actual") == STATES[1], F.col(P[1])).otherwise(F.col(P[2]))
    loss = -F.ln(F.least(F.greatest(hit, F.lit(1e-12)), F.lit(1.0)))
    start = F.min("target_week").over(Window.partitionBy(key))
    weeks = lambda d: F.datediff(d, start) / 7.0
    rows = history.withColumns({"_up": loss * F.pow(F.lit(2.0), weeks(F.col("target_week")) / half_life), "_at": weeks(F.col("origin"))})
    past = Window.partitionBy(key, "model").orderBy("origin").rowsBetween(Window.unboundedPreceding, -2)
    rows = rows.withColumns({"history_rows": F.count("_up").over(past), "discounted_log_loss": F.coalesce(F.sum("_up").over(past), F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("_at") / half_life)})
    at = Window.partitionBy(key, "origin")
    warm = F.col("history_rows") < least
    raw = F.when(warm, 1.0).otherwise(F.exp(F.min("discounted_log_loss").over(at) - F.col("discounted_log_loss")))
    rows = rows.withColumn("_raw", raw)
    return rows.withColumns({"weight": F.col("_raw") / F.sum("_raw").over(at), "warmup": warm}).drop("_up", "_at", "_raw")


def blend(weighted: DataFrame, key: str = "series_id") -> DataFrame:
    """The weighted mixture of the experts at every origin."""
    return weighted.groupBy(key, "origin").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in P], F.first("actual").alias("actual"))


def convex_blend(pairs: DataFrame, keys: list[str], steps: int = 1000) -> DataFrame:
    """Weight of (p_left, p_right), the two probabilities of what happened, with the least mean log loss; ties nearest to one half."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    w = F.col("k") / steps
    mixed = w * F.col("p_left") + (1 - w) * F.col("p_right")
    scored = pairs.select(*keys, "p_left", "p_right", grid).groupBy(*keys, "k").agg(F.round(F.avg(-F.ln(F.greatest(mixed, F.lit(1e-12)))), 10).alias("loss"))
    best = scored.groupBy(*keys).agg(F.min(F.struct(F.col("loss"), F.abs(F.col("k") - steps // 2).alias("far"), F.col("k"))).alias("b"))
    return best.select(*keys, (F.col("b.k") / steps).alias("weight"), F.col("b.loss").alias("log_loss"))


def hazard_destination(rows: DataFrame) -> DataFrame:
    """Current state keeps 1 - p_change; the rest is split over the others in proportion to max(p, 1e-6)."""
    floor = [F.when(F.col("current_state") == s, 0.0).otherwise(F.greatest(F.col(c), F.lit(1e-6))) for s, c in zip(STATES, P, strict=True)]
    total = floor[0] + floor[1] + floor[2]
    return rows.withColumns({f"j_{s}": F.when(F.col("current_state") == s, 1 - F.col("p_change")).otherwise(F.col("p_change") * f / total) for s, f in zip(STATES, floor, strict=True)})


def survival(hazards: DataFrame, horizons=(1, 4, 13)) -> DataFrame:
    """Cumulative departure risk of a constant weekly hazard (column hazard) at each horizon."""
    each = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon"), (1 - F.pow(1 - F.col("hazard"), h)).alias("p_change"), F.pow(1 - F.col("hazard"), h).alias("survival")) for h in horizons])
    return hazards.select("*", F.inline(each))


def probability_violations(rows: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows whose probabilities are missing, outside [0, 1], or do not sum to 1."""
    bad, total = F.lit(False), F.lit(0.0)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return rows.filter(bad | (F.abs(total - 1) > tolerance))

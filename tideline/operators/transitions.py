"""The transition benchmark: departure forecasts by horizon, calibrated, thresholded and chosen by earlier rows only.

A forecast is (keys.., origin, horizon, model, current_state, actual_change, p_change, evaluation_split). It is known at
its target end, 7 * horizon days after the origin. Whatever is learned for an origin comes from *selection* rows whose
target end is before it, so after the cutoff everything is frozen.

History is never joined row by row: a forecast enters the order of time twice, as a question at its origin and as an answer
at its target end, and running sums over that order give every question its history (an answer at the very time of a
question is too late for it). Work grows with the rows; a group is one (keys, horizon, model).

Prospective forecasts are those whose horizon is still open. They have no outcome column at all, so no metric can read them.

Defined results: rows without an outcome are no history; an origin that lacks the chosen model gives no row; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import baselines, metrics

SELECTION, DIAGNOSTIC, PROSPECTIVE = "selection", "retrospective_diagnostic", "prospective"
GAIN, BRIER = 0.005, 0.005
#: The order of the candidates by complexity.
COMPLEXITY = {"regularized_logistic": 0, "duration_tvtp_hurdle": 1, "binary_xgboost": 2, "joint_survival_hazard": 3}


def target_end() -> Column:
    return F.date_add("origin", (7 * F.col("horizon")).cast("int"))


def with_split(forecasts: DataFrame, cutoff: str) -> DataFrame:
    """``forecasts`` with evaluation_split: selection needs the whole horizon before ``cutoff``, the diagnostic an origin on
    or after it; the origins between are left out."""
    limit = F.lit(cutoff).cast("date")
    split = F.when(target_end() < limit, SELECTION).when(F.col("origin") >= limit, DIAGNOSTIC)
    return forecasts.withColumn("evaluation_split", split).filter("evaluation_split IS NOT NULL")


def _timeline(rows: DataFrame, carried: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Questions (answer = 0, amounts 0) and answers (answer = 1) of the rows on one time axis."""
    known = (F.col("evaluation_split") == SELECTION) & F.col("actual_change").isNotNull()
    question = F.struct(F.col("origin").alias("_at"), F.lit(0).alias("_answer"), *[F.lit(0.0).alias(n) for n in amounts])
    answer = F.struct(target_end().alias("_at"), F.lit(1).alias("_answer"), *[F.when(known, a).otherwise(0.0).cast("double").alias(n) for n, a in amounts.items()])
    return rows.select(*carried, F.inline(F.array(question, answer)))


def _before(keys: list[str]):
    """All that is known at a question: rows of an earlier time, and answers never count at their own time."""
    return Window.partitionBy(*keys).orderBy("_at", "_answer").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def running_scores(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Per forecast: n, log_loss, brier and fallback_count of the model's history, and history_origins of all models."""
    y, p = F.col("actual_change"), F.col("p_change")
    fell = F.col("fallback").cast("double") if "fallback" in forecasts.columns else F.lit(0.0)
    amounts = {
        "n": F.lit(1.0), "loss": -F.when(y, F.ln(p)).otherwise(F.ln(1 - p)), "square": F.pow(p - y.cast("double"), 2), "fell": fell,
    }
    group = [*keys, "horizon", "model"]
    carried = [*group, "origin", "evaluation_split"]
    lined = _timeline(forecasts, carried, amounts)
    sums = lined.withColumns({a: F.sum(a).over(_before(group)) for a in amounts}).filter("_answer = 0")
    scored = sums.select(*carried, "n", F.round(F.col("loss") / F.col("n"), 9).alias("log_loss"), F.round(F.col("square") / F.col("n"), 9).alias("brier"), F.col("fell").alias("fallback_count"))
    origins = forecasts.groupBy(*keys, "horizon", "origin", "evaluation_split").agg(F.max("actual_change").alias("actual_change"))
    counted = _timeline(origins, [*keys, "horizon", "origin"], {"n": F.lit(1.0)}).withColumn("history_origins", F.sum("n").over(_before([*keys, "horizon"]))).filter("_answer = 0")
    return scored.join(counted.select(*keys, "horizon", "origin", F.col("history_origins").cast("long").alias("history_origins")), [*keys, "horizon", "origin"])


def _choice(scores: DataFrame, group: list[str], base: list[str], gain: float, brier: float) -> DataFrame:
    """(group, selected_model, selection_reason) by the best baseline and the candidates that clearly beat it."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv]), F.col("model")), F.lit(99))
    is_base = F.col("model").isin(base)
    shadow = F.col("model") == "joint_survival_hazard"
    rows = scores.filter(~shadow).groupBy(*group).agg(
        F.min(F.when(is_base, F.struct("log_loss", "brier", "model"))).alias("base"),
        F.min(F.struct("log_loss", "brier", "fallback_count", "model")).alias("best"),
        F.collect_list(F.when(~is_base, F.struct("log_loss", "brier", rank.alias("rank"), "model", "fallback_count"))).alias("others"),
    )  # a struct for each candidate
    passed = F.array_min(
        F.filter("others", lambda c: (c["fallback_count"] == 0) & (c["log_loss"] <= F.col("base.log_loss") - gain) & (c["brier"] <= F.col("base.brier") + brier))
    )
    chosen = rows.withColumn("passed", passed)
    return chosen.select(
        *group,
        F.when(F.col("base").isNull(), F.col("best.model")).otherwise(F.coalesce("passed.model", "base.model")).alias("selected_model"),
        F.when(F.col("base").isNull(), "lowest_prequential_log_loss:no_baseline_candidate")
        .when(F.col("passed").isNotNull(), "passed_probability_baseline_gate")
        .otherwise("conservative_probability_baseline_gate")
        .alias("selection_reason"),
    )


def nested_selection(
    forecasts: DataFrame, keys: list[str], base: list[str], first_choice: str = "markov_hazard", least: int = 12, gain: float = GAIN, brier: float = BRIER
) -> DataFrame:
    """(keys, horizon, origin, evaluation_split, selected_model, selection_reason, selection_history_origins, selection_locked).

    The family of every origin is chosen anew by the scores of earlier selection rows. With fewer than ``least`` origins of
    history it is ``first_choice``, or the first model by name where that does not forecast.
    """
    group = [*keys, "horizon", "origin", "evaluation_split"]
    scores = running_scores(forecasts, keys)
    chosen = _choice(scores.filter("n > 0"), group, base, gain, brier)
    known = scores.groupBy(*group).agg(F.max("history_origins").alias("n"), F.coalesce(F.max(F.when(F.col("model") == first_choice, F.col("model"))), F.min("model")).alias("first"))
    few = F.col("n") < least
    reason = F.concat(F.lit("fallback_family:insufficient_prequential_origins:"), F.col("n").cast("string"), F.lit(f"<{least}"))
    return known.join(chosen, group, "left").select(
        *group,
        F.when(few, F.col("first")).otherwise(F.col("selected_model")).alias("selected_model"),
        F.when(few, reason).otherwise(F.col("selection_reason")).alias("selection_reason"),
        F.col("n").alias("selection_history_origins"),
        (F.col("evaluation_split") == DIAGNOSTIC).alias("selection_locked"),
    )


def prequential_thresholds(forecasts: DataFrame, keys: list[str], least: int = 12) -> DataFrame:
    """(keys, horizon, model, origin, threshold): for every forecast the threshold of .05, .06, ... .95 with the best balanced
    accuracy over the model's history; ties go to the nearest to .5, then the larger. With fewer than ``least`` rows, or
    only one outcome, it is .5. The grid has 91 values, so a row enters the order of time 91 times."""
    group = [*keys, "horizon", "model"]
    y, over = F.col("actual_change"), F.col("p_change") >= F.col("t") / 100
    amounts = {"pos": y.cast("double"), "neg": (~y).cast("double"), "tp": (y & over).cast("double"), "tn": (~y & ~over).cast("double")}
    graded = forecasts.withColumn("t", F.explode(F.sequence(F.lit(5), F.lit(95))))
    lined = _timeline(graded, [*group, "origin", "t"], amounts)
    sums = lined.withColumns({a: F.sum(a).over(_before([*group, "t"])) for a in amounts}).filter("_answer = 0")
    few = (F.col("pos") + F.col("neg") < least) | (F.col("pos") == 0) | (F.col("neg") == 0)
    score = F.round((F.col("tp") / F.col("pos") + F.col("tn") / F.col("neg")) / 2, 10)
    best = F.max(F.when(~few, F.struct(score.alias("s"), (-F.abs(F.col("t") - 50)).alias("near"), F.col("t")))).alias("b")
    return sums.groupBy(*group, "origin").agg(best).select(*group, "origin", F.coalesce(F.col("b.t") / 100, F.lit(0.5)).alias("threshold"))


def prospective_hazards(states: DataFrame, min_train: int, horizons: tuple[int, ...] = (1, 4, 13)) -> DataFrame:
    """Departure forecasts of the origins whose horizon is still open: the last h weeks of each series for horizon h.

    Both hazards learn from rows whose horizon was over before the origin, as the scored ones do. There is no outcome:
    (series_id, origin, target_end, horizon, model, current_state, p_change, train_size, evaluation_split).
    """
    out = None
    for h in horizons:
        part = baselines.hazard_rows(states, min_train, h).filter("event IS NULL").drop("event")
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"target_end": target_end(), "evaluation_split": F.lit(PROSPECTIVE)})


def benchmark(forecasts: DataFrame, keys: list[str], base: list[str], least: int = 12) -> dict[str, DataFrame]:
    """The parts of the benchmark over scored forecasts with evaluation_split: predictions with prequential thresholds, the
    leaderboard by split with the champion marked, and the nested selection."""
    group = [*keys, "horizon", "model"]
    thresholds = prequential_thresholds(forecasts, keys, least)
    predictions = forecasts.join(thresholds, [*group, "origin"]).withColumn("predicted_change", F.col("p_change") >= F.col("threshold"))
    board = metrics.event_scores(predictions, [*group, "evaluation_split"])
    scores = board.filter(F.col("evaluation_split") == SELECTION).withColumns({"log_loss": F.round("log_loss", 9), "brier": F.round("brier", 9)})
    fell = F.sum(F.col("fallback").cast("double")) if "fallback" in forecasts.columns else F.lit(0.0)
    falls = forecasts.filter(F.col("evaluation_split") == SELECTION).groupBy(*group).agg(fell.alias("fallback_count"))
    champions = _choice(scores.join(falls, group), [*keys, "horizon"], base, GAIN, BRIER)
    marked = board.join(champions, [*keys, "horizon"], "left").withColumn("selected", F.coalesce(F.col("model") == F.col("selected_model"), F.lit(False)))
    return {
        "predictions": predictions,
        "leaderboard": marked.drop("selected_model", "selection_reason"),
        "nested_selection": nested_selection(predictions, keys, base, least=least),
        "champions": champions,
    }

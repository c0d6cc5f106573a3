"""Structural candidates: a departure hazard joined with a destination forecast, and a causal ensemble of experts.

Forecasts are (keys.., origin, target_week, model, current_state, actual, p_* and optionally fallback, fallback_reason,
evaluation_split); hazards are (keys.., origin, horizon, current_state, actual_change, p_change and optionally fallback,
fallback_reason, calibration_fallback). An outcome that is still open is NULL.

Pairs are checked where they are joined: an origin that either side holds twice, or on whose target, state or outcome the
sides differ, fails the job with its reason (``pairing_violations`` lists them instead). Origins that only one side has
give no row. Work is aggregations and running sums by key; a group is one key's series of weeks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import metrics, selection
from tideline.operators.labels import STATES

P = metrics.P
JOINT, ENSEMBLE = "hazard_destination", "causal_dynamic_ensemble"
HALF_LIFE, LEAST = 52.0, 26


def _with_fallback(rows: DataFrame) -> DataFrame:
    """``rows`` with fallback and fallback_reason; where they are missing, nothing fell back."""
    fell = F.coalesce(F.col("fallback"), F.lit(False)) if "fallback" in rows.columns else F.lit(False)
    if "calibration_fallback" in rows.columns:
        fell = fell | F.coalesce(F.col("calibration_fallback"), F.lit(False))
    why = F.coalesce(F.col("fallback_reason"), F.lit("")) if "fallback_reason" in rows.columns else F.lit("")
    return rows.withColumns({"fallback": fell, "fallback_reason": why})


def _paired(base: DataFrame, hazards: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each origin of both sides: b and h, a row of each, and reason, NULL where they fit."""
    at = [*keys, "origin"]
    hazards = _with_fallback(hazards).withColumn("target_week", F.date_add("origin", (7 * F.col("horizon")).cast("int")))
    each = F.struct("target_week", "current_state", "actual_change", "p_change", "fallback", "fallback_reason")
    right = hazards.groupBy(*at).agg(F.count(F.lit(1)).alias("n_h"), F.min(each).alias("h"))
    base = _with_fallback(base)
    left = base.groupBy(*at).agg(F.count(F.lit(1)).alias("n_b"), F.min(F.struct(*[c for c in base.columns if c not in at])).alias("b"))
    moved = F.col("b.actual") != F.col("b.current_state")
    known = F.coalesce((F.col("h.p_change") > 0) & (F.col("h.p_change") < 1), F.lit(False))
    reason = (
        F.when(F.col("n_b") > 1, "duplicate_forecast")
        .when(F.col("n_h") > 1, "duplicate_hazard")
        .when(~F.col("b.target_week").eqNullSafe(F.col("h.target_week")), "target_week")
        .when(~F.col("b.current_state").eqNullSafe(F.col("h.current_state")), "current_state")
        .when(~moved.eqNullSafe(F.col("h.actual_change")), "outcome")
        .when(~known, "p_change")
    )
    return left.join(right, at).withColumn("reason", reason)


def pairing_violations(base: DataFrame, hazards: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, origin, reason) of the origins at which forecasts and one-step hazards do not fit."""
    return _paired(base, hazards, keys).filter("reason IS NOT NULL").select(*keys, "origin", "reason")


def joint_forecasts(base: DataFrame, hazards: DataFrame, keys: list[str]) -> DataFrame:
    """The forecasts of JOINT: who leaves is the hazard's say, where to that of ``base`` (one model, one row an origin).

    It falls back where either side did, or the hazard's calibration.
    """
    own = [c for c in _with_fallback(base).columns if c not in (*keys, "origin")]
    rows = _paired(base, hazards, keys)
    broken = F.raise_error(F.concat(F.lit("forecast and hazard differ: "), F.col("reason"))).cast("double")
    rows = rows.select(*keys, "origin", "b.*", F.when(F.col("reason").isNotNull(), broken).otherwise(F.col("h.p_change")).alias("p_change"), F.col("h").alias("_h"))
    said = metrics.hazard_destination(rows)
    part = lambda name, fell, why: F.when(fell, F.concat(F.lit(f"{name}:"), why))
    why = F.concat_ws(";", part("forecast", F.col("fallback"), F.col("fallback_reason")), part("hazard", F.col("_h.fallback"), F.col("_h.fallback_reason")))
    changed = {c: F.col(f"j_{s}") for c, s in zip(P, STATES, strict=True)} | {"model": F.lit(JOINT), "fallback_reason": why, "fallback": F.col("fallback") | F.col("_h.fallback")}
    return said.withColumns(changed).select(*keys, "origin", *own)


def _weeks(day: Column, start: Column) -> Column:
    return F.datediff(day, start) / 7.0


def dynamic_ensemble(experts: DataFrame, keys: list[str], names: list[str], half_life: float = HALF_LIFE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The forecasts of ENSEMBLE, and its weights (keys, origin, target_week, expert, weight, eligible, history_rows,
    latest_target, discounted_log_loss, warmup).

    Weights are a softmax of minus the past log loss, which fades by half every ``half_life`` weeks. History of an origin are
    the targets before it at which no expert fell back, whatever their split. Below ``least`` of them the experts weigh the
    same. An expert that falls back now weighs nothing; where all do, the forecast is uniform and a fallback itself.

    Fading sums are plain running sums of loss * 2 ** (weeks to the target / half life), scaled at the origin, so no origin
    is joined with its past. Their range limits the span of a series to 1,000 half-lives; beyond it the job fails, as it
    does if an origin lacks an expert, has one twice, or the experts differ on state or outcome.
    """
    if len(set(names)) < 2 or len(set(names)) != len(names) or half_life <= 0 or least < 1:
        raise ValueError("an ensemble needs two different experts, a positive half-life and a positive warm-up")
    shared = ["current_state", "actual", *(["evaluation_split"] if "evaluation_split" in experts.columns else [])]
    rows = _with_fallback(experts).filter(F.col("model").isin(names))
    per = {f"e{i}": F.max(F.when(F.col("model") == n, F.struct(*P, "fallback"))) for i, n in enumerate(names)}
    wide = rows.groupBy(*keys, "origin", "target_week").agg(
        *[v.alias(k) for k, v in per.items()], F.max(F.struct(*shared)).alias("hi"), F.min(F.struct(*shared)).alias("lo"), F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("m")
    )
    start = F.min("target_week").over(Window.partitionBy(*keys))
    span = _weeks(F.max("target_week").over(Window.partitionBy(*keys)), start)
    wrong = (F.col("n") != len(names)) | (F.col("m") != len(names)) | ~F.col("hi").eqNullSafe(F.col("lo"))
    checked = F.when(wrong, F.raise_error(F.lit("experts differ in origins, states or outcomes")).cast("date"))
    checked = checked.when(span > 1_000 * half_life, F.raise_error(F.lit("more than 1,000 half-lives")).cast("date")).otherwise(start)
    wide = wide.withColumn("_start", checked).select(*keys, "origin", "target_week", *per, "lo.*", "_start")
    fell = [F.col(f"e{i}.fallback") for i in range(len(names))]
    common = F.col("actual").isNotNull() & ~reduce(lambda a, b: a | b, fell)

    def hit(i: int) -> Column:
        p = [F.col(f"e{i}.{c}") for c in P]
        said = F.when(F.col("actual") == STATES[0], p[0]).when(F.col("actual") == STATES[1], p[1]).otherwise(p[2])
        return -F.ln(F.least(F.greatest(said, F.lit(1e-12)), F.lit(1.0)))

    rise = F.pow(F.lit(2.0), _weeks(F.col("target_week"), F.col("_start")) / half_life)
    amounts = [F.when(common, hit(i) * rise).otherwise(0.0).alias(f"d{i}") for i in range(len(names))]
    question = F.struct(F.col("origin").alias("_at"), F.lit(0).alias("_answer"), *[F.lit(0.0).alias(f"d{i}") for i in range(len(names))], F.lit(None).cast("date").alias("seen"))
    answer = F.struct(F.col("target_week").alias("_at"), F.lit(1).alias("_answer"), *amounts, F.when(common, F.col("target_week")).alias("seen"))
    lined = wide.select("*", F.inline(F.array(question, answer)))
    past = Window.partitionBy(*keys).orderBy("_at", "_answer").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fade = F.pow(F.lit(2.0), -_weeks(F.col("origin"), F.col("_start")) / half_life)
    sums = {f"D{i}": F.sum(f"d{i}").over(past) * fade for i in range(len(names))}
    known = lined.withColumns(sums | {"history_rows": F.count("seen").over(past), "latest_target": F.max("seen").over(past)}).filter("_answer = 0")

    warm = F.col("history_rows") < least
    lowest = F.least(*[F.when(~f, F.col(f"D{i}")) for i, f in enumerate(fell)])
    known = known.withColumns({f"r{i}": F.when(f, 0.0).when(warm, 1.0).otherwise(F.exp(lowest - F.col(f"D{i}"))) for i, f in enumerate(fell)})
    total = reduce(lambda a, b: a + b, [F.col(f"r{i}") for i in range(len(names))])
    known = known.withColumns({f"w{i}": F.when(total > 0, F.col(f"r{i}") / total).otherwise(0.0) for i in range(len(names))} | {"warmup": warm})
    none = reduce(lambda a, b: a & b, fell)
    mixed = [reduce(lambda a, b: a + b, [F.col(f"w{i}") * F.col(f"e{i}.{c}") for i in range(len(names))]) for c in P]
    mass = mixed[0] + mixed[1] + mixed[2]
    predictions = known.select(
        *keys, "origin", "target_week", F.lit(ENSEMBLE).alias("model"), *shared,
        *[F.when(none, F.lit(1 / 3)).otherwise(x / mass).alias(c) for x, c in zip(mixed, P, strict=True)],
        none.alias("fallback"), F.when(none, "all_experts_fell_back").otherwise("").alias("fallback_reason"),
        F.concat_ws(";", *[F.when(f, n) for n, f in zip(names, fell, strict=True)]).alias("excluded_experts"),
    )
    each = [F.struct(F.lit(n).alias("expert"), F.col(f"w{i}").alias("weight"), (~f).alias("eligible"), F.col(f"D{i}").alias("discounted_log_loss")) for i, (n, f) in enumerate(zip(names, fell, strict=True))]
    weights = known.select(*keys, "origin", "target_week", "history_rows", "latest_target", "warmup", F.inline(F.array(*each)))
    return predictions, weights


def augment(base: DataFrame, hazards: DataFrame, keys: list[str], destination: str, experts: list[str], half_life: float = HALF_LIFE, least: int = LEAST) -> dict[str, DataFrame]:
    """``base`` with JOINT and ENSEMBLE beside it: predictions of all models at the origins of JOINT, and the weights.

    ``destination`` is the model of ``base`` that says where to; ``experts`` are models of ``base``, JOINT joins them.
    """
    base = _with_fallback(base)
    joint = joint_forecasts(base.filter(F.col("model") == destination), hazards, keys)
    at = [*keys, "origin", "target_week"]
    common = base.join(joint.select(at), at, "left_semi")
    ensemble, weights = dynamic_ensemble(common.filter(F.col("model").isin(experts)).unionByName(joint), keys, [*experts, JOINT], half_life, least)
    return {"predictions": common.unionByName(joint).unionByName(ensemble.drop("excluded_experts").select(common.columns)), "weights": weights}


def regate(predictions: DataFrame, keys: list[str], baselines: list[str], complexity: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(leaderboard by split, gates) of augmented predictions with evaluation_split; the gates read selection rows only.

    Each challenger is tested against the best baseline of the selection rows with the sign test of blocks.
    """
    board = _rounded(metrics.leaderboard(predictions, [*keys, "model", "evaluation_split"]))
    own = board.filter("evaluation_split = 'selection'").drop("evaluation_split")
    losses = metrics.prepared(predictions.filter("evaluation_split = 'selection'")).select(*keys, "model", "origin", (-F.ln("hit")).alias("loss"))
    best = own.filter(F.col("model").isin(baselines)).groupBy(*keys).agg(F.min(F.struct("log_loss", "calibration_error", "model"))["model"].alias("model"))
    reference = losses.join(best, [*keys, "model"]).select(*keys, "origin", F.col("loss").alias("reference"))
    paired = losses.filter(~F.col("model").isin(baselines)).join(reference, [*keys, "origin"]).withColumn("improvement", F.col("reference") - F.col("loss"))
    tested = selection.block_sign_test(paired, keys, "model", "origin").select(*keys, "model", F.round("p", 12).alias("p"))
    return board, selection.gated_champion(own, tested, keys, baselines, complexity)


def forecast(base: DataFrame, hazards: DataFrame, keys: list[str], destination: str, experts: list[str], horizons: tuple[int, ...] = (1, 4, 13), **options) -> DataFrame:
    """What all models say at the last origin of each key: the predictions of ``augment`` there, with weight, the ensemble's
    weight of an expert, and p_change_{h}w, the departure risk within h weeks if the weekly hazard stays as it is.

    ``base`` and ``hazards`` hold the past with its outcomes and the last origin without one; only the past has weight.
    """
    found = augment(base, hazards, keys, destination, experts, **options)
    last = found["predictions"].groupBy(*keys).agg(F.max("origin").alias("origin"))
    risks = [(1 - F.pow(1 - F.col("p_change"), h)).alias(f"p_change_{h}w") for h in horizons]
    weights = found["weights"].select(*keys, "origin", F.col("expert").alias("model"), "weight")
    said = found["predictions"].join(last, [*keys, "origin"]).join(weights, [*keys, "origin", "model"], "left")
    return said.join(hazards.select(*keys, "origin", *risks), [*keys, "origin"])


def _rounded(board: DataFrame) -> DataFrame:
    return board.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in board.dtypes])

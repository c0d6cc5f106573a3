"""Walk-forward baselines as window frames: the training set of an origin is a frame that ends before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.labels import STATES

FLOOR = 1e-9


def _normal(raw: list[Column]) -> list[Column]:
    total = raw[0] + raw[1] + raw[2]
    return [x / total for x in raw]


def _one_hot(state: Column) -> list[Column]:
    return _normal([F.when(state == s, 1.0).otherwise(FLOOR) for s in STATES])


def forecast_rows(states: DataFrame, gap: int = 1) -> DataFrame:
    """Next-state forecasts of majority, persistence, markov and class prior at every row of (series_id, week, state).

    Training pairs (state, next state) of an origin at position p are those of rows 0 to p - gap - 1. At the last row of a
    series actual is NULL and target_week a week later.
    """
    order = Window.partitionBy("series_id").orderBy("week")
    prefix = order.rowsBetween(Window.unboundedPreceding, -(gap + 1))
    target = F.coalesce(F.lead("week").over(order), F.date_add("week", 7))
    rows = states.withColumns({"pos": F.row_number().over(order) - 1, "next": F.lead("state").over(order), "target_week": target})
    counts = {f"c_{i}{j}": F.sum(((F.col("state") == a) & (F.col("next") == b)).cast("int")).over(prefix) for i, a in enumerate(STATES) for j, b in enumerate(STATES)}
    rows = rows.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in counts.items()})
    c = [[F.col(f"c_{i}{j}") for j in range(3)] for i in range(3)]
    n = [c[0][j] + c[1][j] + c[2][j] for j in range(3)]
    top = F.greatest(*n)
    majority = F.when(n[0] == top, STATES[0]).when(n[1] == top, STATES[1]).otherwise(STATES[2])
    own = [F.when(F.col("state") == STATES[0], c[0][j]).when(F.col("state") == STATES[1], c[1][j]).otherwise(c[2][j]) for j in range(3)]
    total = n[0] + n[1] + n[2]
    models = {
        "majority": _one_hot(majority),
        "persistence": _one_hot(F.col("state")),
        "markov": [(own[j] + 1) / (own[0] + own[1] + own[2] + 3) for j in range(3)],
        "class_prior": [(n[j] + 1) / (total + 3) for j in range(3)],
    }
    forecasts = F.array(*[F.struct(F.lit(m).alias("model"), *[x.alias(f"p_{s}") for x, s in zip(p, STATES, strict=True)]) for m, p in models.items()])
    return rows.select("series_id", F.col("week").alias("origin"), "target_week", F.col("pos").cast("long").alias("pos"), F.col("state").alias("current_state"), F.col("next").alias("actual"), total.cast("long").alias("train_size"), F.inline(forecasts))


def walk_forward(states: DataFrame, min_train: int, gap: int = 1) -> DataFrame:
    """``forecast_rows`` of the origins with enough history whose outcome is known."""
    return forecast_rows(states, gap).filter((F.col("pos") >= min_train + gap) & F.col("actual").isNotNull())


def forecast_next(states: DataFrame, min_train: int, as_of: str | None = None, gap: int = 1) -> DataFrame:
    """(series_id, origin, model, current_state, train_size, p_*, status): the next-week chances at the last row of each series
    no later than ``as_of``, or at its last row.

    Nothing after ``as_of`` is read. A series with too little history has NULL chances and says so in its status; one that
    starts later gives no row. Chances are at least 1e-9 and sum to 1.
    """
    known = states if as_of is None else states.filter(F.col("week") <= F.lit(as_of).cast("date"))
    rows = forecast_rows(known, gap).filter("actual IS NULL AND current_state IS NOT NULL")
    last = Window.partitionBy("series_id")
    rows = rows.withColumn("_last", F.max("origin").over(last)).filter("origin = _last")
    enough, history = F.col("pos") - gap >= min_train, F.greatest(F.col("pos") - gap, F.lit(0))
    p = [F.greatest(F.col(f"p_{s}"), F.lit(FLOOR)) for s in STATES]
    chances = [F.when(enough, x).alias(f"p_{s}") for x, s in zip(_normal(p), STATES, strict=True)]
    status = F.when(enough, "ok").otherwise(F.concat(F.lit("not_enough_history:"), history.cast("string"), F.lit(f"<{min_train}")))
    return rows.select("series_id", "origin", "model", "current_state", "train_size", *chances, status.alias("status"))


def hazard_rows(states: DataFrame, min_train: int, h: int) -> DataFrame:
    """(series_id, origin, horizon, current_state, event, train_size, model, p_change) of every origin for one horizon; the
    event, a departure within it, is NULL while the horizon is open."""
    order = Window.partitionBy("series_id").orderBy("week")
    ahead, prefix = order.rowsBetween(1, h), order.rowsBetween(Window.unboundedPreceding, -(h + 1))
    event = F.when(F.count("state").over(ahead) == h, F.size(F.filter(F.collect_list("state").over(ahead), lambda s: s != F.col("state"))) > 0)
    rows = states.withColumn("event", event).withColumns({"pos": F.row_number().over(order) - 1, "next": F.lead("state").over(order)})
    own = {f"s_{i}": F.sum(((F.col("state") == a) & (F.col("next") == a)).cast("int")).over(prefix) for i, a in enumerate(STATES)}
    all_ = {f"n_{i}": F.sum((F.col("state") == a).cast("int")).over(prefix) for i, a in enumerate(STATES)}
    rows = rows.withColumns(own | all_ | {"n": F.count("event").over(prefix), "k": F.sum(F.col("event").cast("int")).over(prefix)})
    pick = lambda x: F.when(F.col("state") == STATES[0], F.col(f"{x}_0")).when(F.col("state") == STATES[1], F.col(f"{x}_1")).otherwise(F.col(f"{x}_2"))
    stay = (pick("s") + 1) / (pick("n") + 3)
    forecasts = F.array(
        F.struct(F.lit("empirical_hazard").alias("model"), ((F.col("k") + 1) / (F.col("n") + 2)).alias("p_change")),
        F.struct(F.lit("markov_hazard").alias("model"), (1 - F.pow(stay, h)).alias("p_change")),
    )
    return rows.filter(F.col("pos") >= min_train + h).select(
        "series_id", F.col("week").alias("origin"), F.lit(h).cast("long").alias("horizon"), F.col("state").alias("current_state"), "event", F.col("n").alias("train_size"), F.inline(forecasts)
    )


def hazards(states: DataFrame, min_train: int, horizons=(1, 4, 13)) -> DataFrame:
    """Departure probabilities within each horizon: the share of past events, and 1 - stay**h of the Markov row."""
    out = None
    for h in horizons:
        part = hazard_rows(states, min_train, h).filter("event IS NOT NULL").withColumnRenamed("event", "actual_change").drop("train_size")
        out = part if out is None else out.unionByName(part)
    return out


def split_of(predictions: DataFrame, date: str, cutoff: str, selection: str = "selection", later: str = "holdout") -> DataFrame:
    return predictions.withColumn("evaluation_split", F.when(F.col(date) < F.lit(cutoff).cast("date"), selection).otherwise(later))


def tail_budget(origins: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """The last origins of each key, up to a budget."""
    return origins.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_r") <= budget).drop("_r")

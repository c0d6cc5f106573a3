"""Learned candidates: walk-forward logistic forecasts per series, and pyspark.ml classifiers fitted on a split.

The logistic candidates are refitted at every origin, as the baselines are, on the rows that a purge of ``gap`` weeks
leaves. A group is one series and one block of ``ORIGINS`` origins, with the weeks up to them, so tasks grow with the origins
even of a single series, and a fit is a few Newton steps from the fit of the origin before. Features are imputed by the median of the training rows, with an indicator where a value is missing,
and standardised by them; nothing of a later row enters a forecast.

The elastic net, forests and boosted trees are fitted once by pyspark.ml, on the selection rows of all series together,
and forecast the later rows: a declared deviation from a refit at every origin, which would be thousands of Spark jobs.

Defined results: rows without a state are left out; a NULL or non-finite feature is imputed; a feature without any value
in training is 0; with one class in training the forecast is the smoothed class prior and ``fallback`` is true; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import svm
from tideline.operators.labels import STATES

FLOOR = 1e-9
ORIGINS = 64
#: Inverse penalties of the logistic candidates, and whether the current state is a feature.
CANDIDATES = {"ridge_logistic": (0.10, False), "transition_logistic": (0.05, True)}
HAZARD_C = 0.025
PLATT_C = 0.10
EDGE = 1e-6


def design(train: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices imputed, extended by missing-value indicators and standardised, all by ``train``."""
    known = np.isfinite(train)
    middle = np.array([np.median(train[k, j]) if k.any() else 0.0 for j, k in enumerate(known.T)])
    absent = ~known.all(axis=0)
    out = [np.column_stack([np.where(np.isfinite(x), x, middle), ~np.isfinite(x[:, absent])]).astype(float) for x in (train, rows)]
    centre, scale = out[0].mean(axis=0), out[0].std(axis=0)
    scale[scale < 1e-12] = 1.0
    return tuple((x - centre) / scale for x in out)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, c: float, start: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Weights (classes x 1 + features) that minimise |w|^2 / 2 + c * negative log-likelihood, intercepts free, by Newton steps."""
    x1 = np.column_stack([np.ones(len(x)), x])
    width = x1.shape[1]
    w = np.zeros((classes, width)) if start is None or start.shape != (classes, width) else start.copy()
    hot = np.eye(classes)[y]
    ridge = np.tile(np.r_[1e-8, np.ones(width - 1)], classes)
    for _ in range(steps):
        p = softmax(x1 @ w.T)
        slope = (c * (p - hot).T @ x1).ravel() + ridge * w.ravel()
        if np.abs(slope).max() < 1e-8 * max(1, len(x)):
            break
        bend = np.zeros((classes * width, classes * width))
        for a in range(classes):
            for b in range(a, classes):
                block = c * (x1.T * (p[:, a] * ((a == b) - p[:, b]))) @ x1
                bend[a * width : (a + 1) * width, b * width : (b + 1) * width] = block
                bend[b * width : (b + 1) * width, a * width : (a + 1) * width] = block
        w -= np.linalg.solve(bend + np.diag(ridge), slope).reshape(w.shape)
    return w


def _forecasts(features: np.ndarray, state: np.ndarray, target: np.ndarray, known: np.ndarray, origins: list[int], embargo: int, c: float, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (origins x classes) and fallback flags; the training rows of origin p are those before p - embargo."""
    out, fell, w = np.zeros((len(origins), classes)), np.zeros(len(origins), dtype=bool), None
    for k, p in enumerate(origins):
        rows = np.flatnonzero(known[: max(p - embargo, 0)])
        seen = np.unique(target[rows])
        if len(seen) < 2:
            counts = np.bincount(target[rows], minlength=classes) + 1.0
            out[k], fell[k] = counts / counts.sum(), True
            continue
        train, own = design(features[rows], features[p : p + 1])
        place = {s: n for n, s in enumerate(seen)}
        y = np.array([place[s] for s in target[rows]])
        w = multinomial(train, y, len(seen), c, w)
        out[k, seen] = softmax(np.column_stack([np.ones(1), own]) @ w.T)[0]
    return out, fell


def by_origins(frame: DataFrame, features: list[str], reach: int, run: Callable[[pd.DataFrame, range], pd.DataFrame], schema: str, block: int = 0) -> DataFrame:
    """``run`` over the rows of a series up to each block of origins and ``reach`` weeks behind it, sorted by week, and the
    block's range of positions among the rows with a state."""
    block = block or ORIGINS
    order = Window.partitionBy("series_id").orderBy("week")
    rows = frame.select("series_id", "week", "state", *[F.col(c).cast("double").alias(c) for c in features]).filter(F.col("state").isin(*STATES))
    rows = rows.withColumns({"_pos": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    first = F.greatest(F.floor((F.col("_pos") - reach) / block), F.lit(0)).cast("int")
    needed = rows.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("_n") - 1) / block).cast("int"))))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return run(part.sort_values("week"), range(key[1] * block, (key[1] + 1) * block))

    return needed.groupBy("series_id", "_block").applyInPandas(one, schema)


def walk_forward(frame: DataFrame, features: list[str], min_train: int, gap: int = 1) -> DataFrame:
    """Next-state forecasts of the logistic candidates at every origin of (series_id, week, state, features).

    series_id, origin, target_week, pos, current_state, actual, train_size, model, p_<state>, fallback.
    """
    code = {s: k for k, s in enumerate(STATES)}

    def run(rows: pd.DataFrame, own: range) -> pd.DataFrame:
        n, out = len(rows), []
        origins = [k for k in range(min_train + gap, n - 1) if k in own]
        if not origins:
            return pd.DataFrame(columns=names)
        state = rows["state"].map(code).to_numpy()
        target = np.r_[state[1:], 0]
        known = np.r_[np.ones(n - 1, dtype=bool), False]
        plain = rows[features].to_numpy(float)
        with_state = np.column_stack([plain, np.eye(len(STATES))[state]])
        week = rows["week"].to_numpy()
        for model, (c, own_state) in CANDIDATES.items():
            p, fell = _forecasts(with_state if own_state else plain, state, target, known, origins, gap, c, len(STATES))
            p = np.clip(p, FLOOR, 1)
            p /= p.sum(axis=1, keepdims=True)
            part = pd.DataFrame(
                {
                    "series_id": rows["series_id"].iloc[0], "origin": week[origins], "target_week": week[[k + 1 for k in origins]], "pos": origins,
                    "current_state": [STATES[state[k]] for k in origins], "actual": [STATES[target[k]] for k in origins],
                    "train_size": [max(k - gap, 0) for k in origins], "model": model,
                }
                | {f"p_{s}": p[:, k] for k, s in enumerate(STATES)}
                | {"fallback": fell}
            )
            out.append(part)
        return pd.concat(out)

    columns = ["series_id string", "origin date", "target_week date", "pos long", "current_state string", "actual string", "train_size long", "model string"]
    columns += [*(f"p_{s} double" for s in STATES), "fallback boolean"]
    names = [c.split()[0] for c in columns]
    return by_origins(frame, features, 1, run, ", ".join(columns))


def _hurdle(x: np.ndarray, state: np.ndarray, target: np.ndarray, rows: np.ndarray, p: int, c: float, warm: dict) -> tuple[np.ndarray, str]:
    """Probabilities of the next state at row ``p`` and the reasons for a fallback, from the training rows.

    A logistic hazard of leaving times a logistic choice among the neighbours of the current state; risk_on and risk_off
    are no neighbours. Where a fit lacks a class, smoothed counts of the source state stand in.
    """
    near = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], dtype=float)
    now, to = state[rows], target[rows]
    leaves = now != to
    train, own = design(x[rows], x[p : p + 1])
    own1, reasons = np.column_stack([np.ones(1), own]), []
    if len(np.unique(leaves)) == 2:
        warm["hazard"] = multinomial(train, leaves.astype(int), 2, c, warm.get("hazard"))
        hazard = softmax(own1 @ warm["hazard"].T)[0, 1]
    else:
        mine = now == state[p]
        hazard = (leaves[mine].sum() + 1) / (mine.sum() + 2)
        reasons.append("hazard_class_missing")
    allowed = leaves & (near[now, to] > 0)
    seen, choice = np.unique(to[allowed]), np.zeros(len(STATES))
    if len(seen) >= 2:
        place = {s: n for n, s in enumerate(seen)}
        warm["to"] = multinomial(train[allowed], np.array([place[s] for s in to[allowed]]), len(seen), c, warm.get("to"))
        choice[seen] = softmax(own1 @ warm["to"].T)[0]
    else:
        choice = near[state[p]] + np.bincount(to[allowed & (now == state[p])], minlength=len(STATES))
        reasons.append("destination_class_missing")
    choice = choice * near[state[p]]
    choice = choice / choice.sum() if choice.sum() > 0 else near[state[p]] / near[state[p]].sum()
    out = hazard * choice
    out[state[p]] += 1 - hazard
    return out / out.sum(), ";".join(reasons)


def hurdle(frame: DataFrame, features: list[str], min_train: int, gap: int = 1, c: float = 0.10) -> DataFrame:
    """Next-state forecasts of the duration-aware hurdle at every origin of (series_id, week, state, features).

    The weeks spent in the current state and the state itself join the features. series_id, origin, target_week, pos,
    current_state, actual, train_size, model, p_<state>, p_change, fallback, fallback_reason.
    """
    code = {s: k for k, s in enumerate(STATES)}

    def run(rows: pd.DataFrame, own: range) -> pd.DataFrame:
        origins = [k for k in range(min_train + gap, len(rows) - 1) if k in own]
        if not origins:
            return pd.DataFrame(columns=names)
        state = rows["state"].map(code).to_numpy()
        target, starts = np.r_[state[1:], 0], np.r_[True, state[1:] != state[:-1]]
        place = np.arange(len(state))
        duration = place - np.maximum.accumulate(np.where(starts, place, 0)) + 1
        x = np.column_stack([rows[features].to_numpy(float), duration, np.eye(len(STATES))[state]])
        week, warm, out = rows["week"].to_numpy(), {}, []
        for k in origins:
            p, reason = _hurdle(x, state, target, np.arange(k - gap), k, c, warm)
            out.append((rows["series_id"].iloc[0], week[k], week[k + 1], k, STATES[state[k]], STATES[target[k]], k - gap, "duration_hurdle", *p, 1 - p[state[k]], bool(reason), reason))
        return pd.DataFrame(out, columns=names)

    columns = ["series_id string", "origin date", "target_week date", "pos long", "current_state string", "actual string", "train_size long", "model string"]
    columns += [*(f"p_{s} double" for s in STATES), "p_change double", "fallback boolean", "fallback_reason string"]
    names = [c.split()[0] for c in columns]
    return by_origins(frame, features, 1, run, ", ".join(columns))


def hazards(frame: DataFrame, features: list[str], min_train: int, horizons: tuple[int, ...] = (1, 4, 13)) -> DataFrame:
    """Regularised logistic departure probability within each horizon, from (series_id, week, state, features).

    An origin learns from rows whose whole horizon is over before it. series_id, origin, horizon, model, current_state,
    actual_change, p_change, fallback.
    """
    code = {s: k for k, s in enumerate(STATES)}

    def run(rows: pd.DataFrame, own: range) -> pd.DataFrame:
        state, n, out = rows["state"].map(code).to_numpy(), len(rows), []
        x = np.column_stack([rows[features].to_numpy(float), np.eye(len(STATES))[state]])
        for h in horizons:
            known = np.arange(n) + h < n
            left = np.array([bool((state[k + 1 : k + 1 + h] != state[k]).any()) for k in range(n)])
            origins = [k for k in range(min_train + h, n - h) if k in own]
            if not origins:
                continue
            p, fell = _forecasts(x, state, left.astype(int), known, origins, h, HAZARD_C, 2)
            out.append(
                pd.DataFrame(
                    {
                        "series_id": rows["series_id"].iloc[0], "origin": rows["week"].to_numpy()[origins], "horizon": h, "model": "regularized_logistic",
                        "current_state": [STATES[state[k]] for k in origins], "actual_change": left[origins],
                        "p_change": np.clip(p[:, 1], EDGE, 1 - EDGE), "fallback": fell,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    schema = "series_id string, origin date, horizon long, model string, current_state string, actual_change boolean, p_change double, fallback boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return by_origins(frame, features, max(horizons), run, schema)


def platt(forecasts: DataFrame, keys: list[str], least: int = 26) -> DataFrame:
    """``forecasts`` (keys, origin, horizon, evaluation_split, actual_change, p_change) with p_calibrated and calibration_fallback.

    A forecast is calibrated by a logistic fit on the logits of the group's selection forecasts whose horizon ended before
    its origin, so from the cutoff on the fit no longer changes (without the column, all are selection). With fewer than ``least`` of these, or fewer than three of
    either outcome, it stays as it is.
    """
    if "evaluation_split" not in forecasts.columns:
        forecasts = forecasts.withColumn("evaluation_split", F.lit("selection"))
    types = dict(forecasts.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("origin").reset_index(drop=True)
        p = np.clip(rows["p_change"].to_numpy(float), EDGE, 1 - EDGE)
        logit, y = np.log(p / (1 - p)), rows["actual_change"].to_numpy(bool).astype(int)
        week = pd.to_datetime(rows["origin"])
        end = (week + pd.to_timedelta(7 * rows["horizon"], unit="D")).to_numpy()
        usable = (rows["evaluation_split"] == "selection").to_numpy()
        out, fell, w = p.copy(), np.ones(len(rows), dtype=bool), None
        for k, origin in enumerate(week.to_numpy()):
            past = usable & (end < origin)
            if past.sum() < least or min(y[past].sum(), (1 - y[past]).sum()) < 3:
                continue
            w = multinomial(logit[past][:, None], y[past], 2, PLATT_C, w)
            out[k], fell[k] = np.clip(softmax(np.array([[1.0, logit[k]]]) @ w.T)[0, 1], EDGE, 1 - EDGE), False
        return rows[kept].assign(p_calibrated=out, calibration_fallback=fell)

    kept = [*keys, "origin", "evaluation_split", "actual_change", "p_change"]
    if "horizon" not in kept:
        kept.insert(len(keys) + 1, "horizon")
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", p_calibrated double, calibration_fallback boolean"
    return forecasts.select(*kept).groupBy(*keys).applyInPandas(run, schema)


def embargoed(origins: DataFrame, cutoff: str, date: str = "origin") -> DataFrame:
    """(.., evaluation_split) of origins with a horizon in weeks: selection needs the whole horizon before ``cutoff``,
    diagnostic an origin on or after it; the origins between are left out."""
    end, limit = F.date_add(F.col(date), (7 * F.col("horizon")).cast("int")), F.lit(cutoff).cast("date")
    split: Column = F.when(end < limit, "selection").when(F.col(date) >= limit, "diagnostic")
    return origins.withColumn("evaluation_split", split).filter("evaluation_split IS NOT NULL")


#: Names of the candidates that pyspark.ml fits on a split.
SPLIT_MODELS = {"elastic": "elastic_net_logistic", "forest": "random_forest", "boosted": "boosted_trees", "spline": "spline_logistic", "svm": "calibrated_linear_svm"}
ELASTIC_C, ELASTIC_L1, SPLINE_C, COMPONENTS = 0.5, 0.25, 0.10, 8


#: Trees of a forest and boosting rounds by profile.
PROFILES = {"quick": (24, 40), "standard": (160, 160), "full": (350, 300)}


def split_pipeline(kind: str, features: list[str], rows: int, profile: str = "standard"):
    """Median imputation, missing-value indicators and a pyspark.ml classifier: ``elastic``, ``forest``, ``boosted``, or ``spline``, a
    logistic fit on a spline basis of the principal components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler

    from tideline.operators.splines import QuantileSplines

    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in features]], outputCol="features", handleInvalid="keep"),
    ]
    if kind == "elastic":  # a mean loss takes the penalty of a summed one divided by the rows
        last = LogisticRegression(family="multinomial", elasticNetParam=ELASTIC_L1, regParam=1 / (ELASTIC_C * max(rows, 1)), maxIter=200, tol=1e-6, labelCol="label", weightCol="weight")
    elif kind == "spline":
        stages[1].setOutputCol("assembled")
        stages += [
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True),
            PCA(k=min(COMPONENTS, 2 * len(features)), inputCol="scaled", outputCol="components"),
            QuantileSplines(inputCol="components", outputCol="features", knots=3, degree=2),
        ]
        last = LogisticRegression(family="multinomial", regParam=1 / (SPLINE_C * max(rows, 1)), maxIter=200, tol=1e-6, standardization=False, labelCol="label")
    elif kind == "forest":
        last = RandomForestClassifier(numTrees=PROFILES[profile][0], maxDepth=6, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=17, labelCol="label", weightCol="weight")
    else:
        last = OneVsRest(classifier=GBTClassifier(maxIter=PROFILES[profile][1], maxDepth=2, stepSize=0.04, minInstancesPerNode=8, seed=17), labelCol="label", parallelism=len(STATES))
    return Pipeline(stages=[*stages, last])


#: Rows of one task of a fit.
FIT_ROWS = 20_000


def dealt(train: DataFrame, rows: int) -> DataFrame:
    """Training rows in as many partitions as their number asks for, each sorted.

    A fit that persists them runs a task for each partition in every one of its hundreds of jobs; the partitions of the
    shuffle that made them follow the session and not their number, and most would be empty.
    """
    return train.repartition(max(-(-rows // FIT_ROWS), 1), "series_id", "week").sortWithinPartitions("series_id", "week")


def split_forecasts(frame: DataFrame, features: list[str], kind: str, cutoff: str, profile: str = "standard") -> DataFrame:
    """Forecasts of the weeks from ``cutoff`` on, by a classifier fitted on all rows whose next week is before it."""
    from pyspark.ml.functions import vector_to_array

    order = Window.partitionBy("series_id").orderBy("week")
    rows = frame.select("series_id", "week", "state", *[F.col(c).cast("double").alias(c) for c in features]).filter(F.col("state").isin(*STATES))
    rows = rows.withColumns({"actual": F.lead("state").over(order), "target_week": F.lead("week").over(order)}).filter("actual IS NOT NULL")
    rows = rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})
    label = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("actual")) - 1
    rows = rows.withColumn("label", label.cast("double"))
    train, later = rows.filter(F.col("target_week") < F.lit(cutoff).cast("date")), rows.filter(F.col("week") >= F.lit(cutoff).cast("date"))
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    train = dealt(train, sum(sizes.values()))
    if kind == "svm" and sizes:
        found = svm.calibrated(train, later, features)
    elif len(sizes) < 2:
        prior = {s: (sizes.get(float(k), 0) + 1) / (sum(sizes.values()) + len(STATES)) for k, s in enumerate(STATES)}
        found = later.withColumns({f"p_{s}": F.lit(p) for s, p in prior.items()} | {"fallback": F.lit(True)})
    else:
        total = sum(sizes.values())
        weight = sum(F.when(F.col("label") == k, total / (len(sizes) * n)).otherwise(0.0) for k, n in sizes.items())
        model = split_pipeline(kind, features, total, profile).fit(train.withColumn("weight", weight))
        raw = "rawPrediction" if kind == "boosted" else "probability"
        scores = vector_to_array(F.col(raw))
        value = lambda k: F.coalesce(F.get(F.col("_scores"), F.lit(k)), F.lit(0.0))
        own = [1 / (1 + F.exp(-2 * value(k))) if kind == "boosted" else value(k) for k in range(len(STATES))]
        clipped = [F.greatest(x, F.lit(FLOOR)) for x in own]
        found = model.transform(later).withColumn("_scores", scores)
        found = found.withColumns({f"p_{s}": x / (clipped[0] + clipped[1] + clipped[2]) for s, x in zip(STATES, clipped, strict=True)} | {"fallback": F.lit(False)})
    name = F.lit(SPLIT_MODELS[kind]).alias("model")
    return found.select("series_id", F.col("week").alias("origin"), "target_week", F.col("state").alias("current_state"), "actual", name, *[f"p_{s}" for s in STATES], "fallback")


#: Rounds, depth, step, share of rows and of features of the boosted hazards.
HAZARD_TREES = {"maxIter": 120, "maxDepth": 3, "stepSize": 0.04, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.65"}


def boosted_hazards(frame: DataFrame, features: list[str], cutoff: str, horizons: tuple[int, ...] = (1, 4, 13), **trees) -> DataFrame:
    """Departure forecasts of the weeks from ``cutoff`` on whose outcome is known, by boosted trees of each horizon.

    Each horizon has one fit, on the rows of all series whose whole horizon ended before ``cutoff``; the fits run side by side.
    Features that are missing are filled with the training median and flagged. With fewer than three events, or fewer than
    three rows without one, p_change is (events + 1) / (rows + 2) and a fallback. ``trees`` overrides HAZARD_TREES.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = frame.select("series_id", "week", "state", *[F.col(c).cast("double").alias(c) for c in features]).filter(F.col("state").isin(*STATES))
    rows = rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})
    limit, filled = F.lit(cutoff).cast("date"), [f"{c}_filled" for c in features]

    def one(h: int) -> DataFrame:
        ahead = Window.partitionBy("series_id").orderBy("week").rowsBetween(1, h)
        left = F.size(F.filter(F.collect_list("state").over(ahead), lambda s: s != F.col("state"))) > 0
        known = rows.withColumn("actual_change", F.when(F.count("state").over(ahead) == h, left)).filter("actual_change IS NOT NULL")
        known = known.withColumn("label", F.col("actual_change").cast("double"))
        train, later = known.filter(F.date_add("week", 7 * h) < limit), known.filter(F.col("week") >= limit)
        n, events = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        fell = min(events, n - events) < 3
        if fell:
            said = later.withColumn("p_change", F.lit((events + 1) / (n + 2)))
        else:
            boost = GBTClassifier(seed=17, featuresCol="features", labelCol="label", **(HAZARD_TREES | trees))
            steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in features]], outputCol="features"), boost]
            said = Pipeline(stages=steps).fit(train.repartition("series_id").sortWithinPartitions("series_id", "week")).transform(later)
            said = said.withColumn("p_change", vector_to_array("probability")[1])
        p = F.least(F.greatest(F.col("p_change"), F.lit(EDGE)), F.lit(1 - EDGE))
        return said.select(
            "series_id", F.col("week").alias("origin"), F.lit(h).cast("long").alias("horizon"), F.lit("binary_boosted_trees").alias("model"),
            F.col("state").alias("current_state"), "actual_change", p.alias("p_change"), F.lit(fell).alias("fallback"),
        )

    with ThreadPoolExecutor(len(horizons)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, horizons))

"""Linear support vector machine with probabilities calibrated on later weeks than it was fitted on.

The weeks of the training rows are cut into consecutive test folds, all rows of a week in one. For each fold a one-vs-rest
linear machine is fitted on the weeks before it, less ``gap``, and a sigmoid for each class on the fold's scores. A forecast
is the mean of the folds' probabilities.

Defined results: a fold without all classes on both sides is left out; with none left the forecast is the smoothed class
shares, with ``fallback`` true; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.labels import STATES

C = 0.5
FLOOR = 1e-9


def time_folds(weeks: list[dt.date], folds: int, gap: int = 1) -> list[tuple[dt.date, dt.date, dt.date]]:
    """(last training week, first and last test week) of each fold; the test folds are equally long and end with the last week."""
    weeks = sorted(set(weeks))
    size = len(weeks) // (folds + 1)
    starts = [len(weeks) - (folds - k) * size for k in range(folds)] if size else []
    return [(weeks[s - gap - 1], weeks[s], weeks[s + size - 1]) for s in starts if s - gap >= 1]


def _machine(features: list[str], rows: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{c}_filled" for c in features]
    machine = LinearSVC(regParam=1 / (C * max(rows, 1)), maxIter=60, tol=1e-5, weightCol="weight")
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in features]], outputCol="raw", handleInvalid="keep"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            OneVsRest(classifier=machine, labelCol="label", weightCol="weight", parallelism=len(STATES)),
        ]
    )


def _balanced(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with a weight that balances the classes, their number and that of the classes."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = sum((F.when(F.col("label") == k, total / (len(sizes) * n)).otherwise(0.0) for k, n in sizes.items()), F.lit(0.0))
    return rows.withColumn("weight", weight), total, len(sizes)


def _margins(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("_m", vector_to_array(F.col("rawPrediction")))


def _sigmoids(scored: DataFrame) -> list[tuple[float, float]]:
    """Intercept and slope of each class by a logistic fit of the outcome on the margin."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    out = []
    for k in range(len(STATES)):
        own = scored.select(array_to_vector(F.array(F.col("_m")[k])).alias("features"), (F.col("label") == k).cast("double").alias("label"))
        fit = LogisticRegression(maxIter=100, tol=1e-8).fit(own)
        out.append((float(fit.intercept), float(fit.coefficients[0])))
    return out


def calibrated(train: DataFrame, later: DataFrame, features: list[str], folds: int = 3, gap: int = 1) -> DataFrame:
    """``later`` with p_<state> and fallback; both have week, the features with <feature>_missing, and train also label."""
    train = train.persist()
    parts = []
    for last, first, end in time_folds([r["week"] for r in train.select("week").distinct().collect()], folds, gap):  # the calendar's weeks
        before, rows, kinds = _balanced(train.filter(F.col("week") <= F.lit(last)))
        test = train.filter(F.col("week").between(F.lit(first), F.lit(end)))
        if kinds < len(STATES) or test.select("label").distinct().count() < len(STATES):
            continue
        model = _machine(features, rows).fit(before)
        sides = _sigmoids(_margins(model, test).persist())
        parts.append((model, sides))
    if not parts:
        sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        shares = [(sizes.get(float(k), 0) + 1) / (sum(sizes.values()) + len(STATES)) for k in range(len(STATES))]
        return later.withColumns({f"p_{s}": F.lit(p) for s, p in zip(STATES, shares, strict=True)} | {"fallback": F.lit(True)})
    found, sums = later, [F.lit(0.0)] * len(STATES)
    for n, (model, sides) in enumerate(parts):
        found = _margins(model, found).withColumnRenamed("_m", f"_m{n}").drop("raw", "features", "rawPrediction", "prediction", *[f"{c}_filled" for c in features])
        p = [1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(f"_m{n}")[k]))) for k, (a, b) in enumerate(sides)]
        sums = [s + x / (p[0] + p[1] + p[2]) / len(parts) for s, x in zip(sums, p, strict=True)]
    clipped = [F.greatest(s, F.lit(FLOOR)) for s in sums]
    total = clipped[0] + clipped[1] + clipped[2]
    return found.withColumns({f"p_{s}": x / total for s, x in zip(STATES, clipped, strict=True)} | {"fallback": F.lit(False)})

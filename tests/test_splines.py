"""The spline basis by hand, saved and loaded; folds in time."""

import datetime as dt
import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tideline.operators import learned, splines, svm
from tideline.operators.labels import STATES


def vectors(spark, values):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(values)], "k int, a array<double>").select("k", array_to_vector("a").alias("v"))


def test_basis_by_hand(spark, tmp_path):
    frame = vectors(spark, [(0, 5), (1, 5), (2, 5), (-1, 5), (4, 5), (0.5, 5)])
    fitted = splines.QuantileSplines(inputCol="v", outputCol="s").fit(vectors(spark, [(0, 5), (1, 5), (2, 5)]))
    assert fitted.getOrDefault(fitted.places) == [0, 1, 2, 5, 5, 5]
    got = {r.k: r.s for r in fitted.transform(frame).select("k", vector_to_array("s").alias("s")).collect()}
    # quadratic B-splines over the knots -2, -1, 0, 1, 2, 3, 4: at 0 one half of each of the first two
    want = {0: (0.5, 0.5, 0), 1: (0, 0.5, 0.5), 2: (0, 0, 0.5), 5: (0.125, 0.75, 0.125)}
    for k, w in want.items():
        assert np.allclose(got[k], [*w, 0, 0, 0], atol=1e-12), (k, got[k])
    # straight on: at 0 the slopes are -1, 1, 0, at 2 they are 0, 0, -1 (and 1 of the one left out)
    assert np.allclose(got[3], [1.5, -0.5, 0, 0, 0, 0]) and np.allclose(got[4], [0, 0, -1.5, 0, 0, 0])
    fitted.write().overwrite().save(f"{tmp_path}/model")
    loaded = splines.QuantileSplinesModel.load(f"{tmp_path}/model")
    again = {r.k: r.s for r in loaded.transform(frame).select("k", vector_to_array("s").alias("s")).collect()}
    assert again == got
    splines.QuantileSplines(inputCol="v", outputCol="s", knots=4, degree=3).write().overwrite().save(f"{tmp_path}/est")
    back = splines.QuantileSplines.load(f"{tmp_path}/est")
    assert (back.getOrDefault(back.knots), back.getOrDefault(back.degree)) == (4, 3)


def test_basis_sums_to_one_within_the_knots():
    for degree in (1, 2, 3):
        full = splines.knot_vector([0.0, 0.3, 1.0, 2.5], degree)
        for x in np.linspace(0, 2.5, 41):
            assert math.isclose(sum(splines.basis(x, full, degree, 0.0, 2.5, splines._number)), 1, abs_tol=1e-12)


def test_no_fold_sees_later_weeks():
    weeks = [dt.date(2024, 1, 5) + dt.timedelta(7 * k) for k in range(23)]
    found = svm.time_folds(weeks + weeks, 4, gap=2)
    assert len(found) == 4 and found[-1][2] == weeks[-1]
    for last, first, end in found:
        assert last + dt.timedelta(7 * 2) < first <= end
    assert all(a[2] < b[1] for a, b in zip(found, found[1:], strict=False))
    assert svm.time_folds(weeks[:3], 4) == [] and svm.time_folds([], 4) == []


def test_forecasts_of_splines_and_machines(spark):
    draw, rows = np.random.default_rng(4), []
    for s in "ab":
        for k in range(120):
            state = int(draw.integers(0, 3)) if k % 4 == 0 else state  # noqa: F821
            rows.append((s, dt.date(2020, 1, 3) + dt.timedelta(7 * k), STATES[state], float(1 - state + draw.normal(0, 0.2)), None if k % 13 == 0 else float(draw.normal())))
    frame = spark.createDataFrame(rows, "series_id string, week date, state string, score double, noise double")
    changed = frame.withColumn("score", F.when(F.col("week") > "2021-12-03", 50.0).otherwise(F.col("score")))
    for kind in ("spline", "svm"):
        out = {(r.series_id, r.origin): r for r in learned.split_forecasts(frame, ["score", "noise"], kind, "2021-10-01").collect()}
        assert len(out) > 50 and all(math.isclose(sum(r[f"p_{s}"] for s in STATES), 1, abs_tol=1e-9) and not r.fallback for r in out.values())
        loss = -np.mean([math.log(r[f"p_{r.actual}"]) for r in out.values()])
        assert loss < {"spline": 1.05, "svm": 0.9}[kind], (kind, loss)  # an even guess has 1.099
        if kind == "svm":
            continue  # its folds are tested above
        later = {(r.series_id, r.origin): r for r in learned.split_forecasts(changed, ["score", "noise"], kind, "2021-10-01").collect()}
        assert all(math.isclose(r.p_risk_on, later[k].p_risk_on, abs_tol=1e-9) for k, r in out.items() if k[1] <= dt.date(2021, 12, 3))
    few = learned.split_forecasts(frame.filter("week < '2020-02-01' OR week > '2021-12-01'"), ["score", "noise"], "svm", "2021-10-01")
    assert {r.fallback for r in few.collect()} == {True}

"""The transition benchmark against plain loops, and what may not enter it."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tideline.operators import learned, metrics, transitions

CUTOFF = "2021-01-01"
SCHEMA = "series_id string, origin date, horizon long, model string, current_state string, actual_change boolean, p_change double, fallback boolean"


def made(models=("empirical_hazard", "markov_hazard", "regularized_logistic"), seed=5, weeks=110, skill=0.3):
    draw, rows = random.Random(seed), []
    for s in "ab":
        for h in (1, 4):
            for k in range(weeks):
                origin = dt.date(2019, 6, 7) + dt.timedelta(7 * k)
                y = draw.random() < 0.4
                for m in models:
                    edge = skill if m == "regularized_logistic" else 0.0
                    p = min(0.95, max(0.05, 0.4 + (edge if y else -edge) + draw.uniform(-0.05, 0.05)))
                    rows.append((s, origin, h, m, "risk_on", y, round(p, 9), m == "regularized_logistic" and s == "b" and k == 3))
    return rows


def plain(rows, least=12):
    out, cut = {}, dt.date.fromisoformat(CUTOFF)
    groups = defaultdict(list)
    for r in rows:
        end = r[1] + dt.timedelta(7 * r[2])
        split = "selection" if end < cut else "retrospective_diagnostic" if r[1] >= cut else None
        if split:
            groups[r[0], r[2]].append((*r, end, split))
    for (s, h), own in groups.items():
        for origin, split in {(r[1], r[9]) for r in own}:
            past = [r for r in own if r[9] == "selection" and r[8] < origin]
            n = len({r[1] for r in past})
            if n < least:
                out[s, h, origin] = ("markov_hazard", f"fallback_family:insufficient_prequential_origins:{n}<{least}", n)
                continue
            score = {}
            for m in {r[3] for r in past}:
                mine = [r for r in past if r[3] == m]
                loss = sum(-math.log(r[6] if r[5] else 1 - r[6]) for r in mine) / len(mine)
                score[m] = (loss, sum((r[6] - r[5]) ** 2 for r in mine) / len(mine), sum(r[7] for r in mine))
            base = min((score[m][:2], m) for m in ("empirical_hazard", "markov_hazard"))
            good = [(v[:2], m) for m, v in score.items() if not m.endswith("l_hazard") and m != "markov_hazard" and v[2] == 0 and v[0] <= base[0][0] - 0.005 and v[1] <= base[0][1] + 0.005]
            best = min(good) if good else base
            out[s, h, origin] = (best[1], "passed_probability_baseline_gate" if good else "conservative_probability_baseline_gate", n)
    return out


def nested(spark, rows):
    frame = transitions.with_split(spark.createDataFrame(rows, SCHEMA), CUTOFF)
    found = transitions.nested_selection(frame, ["series_id"], ["empirical_hazard", "markov_hazard"])
    return {(r.series_id, r.horizon, r.origin): (r.selected_model, r.selection_reason, r.selection_history_origins) for r in found.collect()}


def test_nested_selection_equals_a_loop(spark):
    rows = made()
    got = nested(spark, rows)
    assert got == plain(rows)
    assert {r[0] for k, r in got.items() if k[0] == "a"} == {"markov_hazard", "regularized_logistic"}
    assert "regularized_logistic" not in {r[0] for k, r in got.items() if k[0] == "b" and r[2] > 20}  # it fell back once
    assert nested(spark, []) == {}


def test_diagnostic_outcomes_change_no_choice(spark):
    rows = made()
    turned = [(*r[:5], not r[5], *r[6:]) if r[1] >= dt.date.fromisoformat(CUTOFF) else r for r in rows]
    assert nested(spark, rows) == nested(spark, turned)
    own = lambda rs: transitions.with_split(spark.createDataFrame([r for r in rs if r[3] == "regularized_logistic"], SCHEMA), CUTOFF)
    platt = lambda rs: {(r.series_id, r.horizon, r.origin): (round(r.p_calibrated, 9), r.calibration_fallback) for r in learned.platt(own(rs), ["series_id", "horizon", "model"]).collect()}
    first, second = platt(rows), platt(turned)
    assert first == second and not all(f for _, f in first.values())


def test_without_a_baseline_and_with_a_shadow(spark):
    rows = made(("joint_survival_hazard", "binary_xgboost", "regularized_logistic"))
    frame = transitions.with_split(spark.createDataFrame(rows, SCHEMA), CUTOFF)
    found = transitions.nested_selection(frame, ["series_id"], ["empirical_hazard", "markov_hazard"]).filter("selection_history_origins >= 12")
    assert {r.selection_reason for r in found.collect()} == {"lowest_prequential_log_loss:no_baseline_candidate"}
    assert {r.selected_model for r in found.collect()} == {"regularized_logistic"}


def test_thresholds_equal_those_of_the_whole_history(spark):
    frame = transitions.with_split(spark.createDataFrame(made(), SCHEMA), CUTOFF)
    got = {(r.series_id, r.horizon, r.model): r.threshold for r in transitions.prequential_thresholds(frame, ["series_id"]).filter("origin >= DATE'2021-03-05'").collect()}
    whole = metrics.best_threshold(frame.filter("evaluation_split = 'selection'"), ["series_id", "horizon", "model"], 12)
    assert got == {(r.series_id, r.horizon, r.model): r.threshold for r in whole.collect()}
    early = transitions.prequential_thresholds(frame, ["series_id"]).filter("origin < DATE'2019-08-01'")
    assert {r.threshold for r in early.collect()} == {0.5}


def test_prospective_rows_have_no_outcome(spark):
    weeks = [("a", dt.date(2020, 1, 3) + dt.timedelta(7 * k), ["risk_on", "transition", "risk_off"][k // 3 % 3]) for k in range(40)]
    states = spark.createDataFrame(weeks, "series_id string, week date, state string")
    rows = transitions.prospective_hazards(states, 10)
    seen = rows.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("n"), F.max("origin").alias("last")).collect()
    assert {(r.horizon, r.n) for r in seen} == {(1, 1), (4, 4), (13, 13)} and {r["last"] for r in seen} == {weeks[-1][1]}
    assert {r.evaluation_split for r in rows.collect()} == {"prospective"}
    for refused in (metrics.event_scores, metrics.average_precision, metrics.best_threshold):
        with pytest.raises(AnalysisException):
            refused(rows.withColumn("predicted_change", F.lit(True)), ["horizon", "model"])
    with pytest.raises(AnalysisException):
        transitions.nested_selection(rows, ["series_id"], ["empirical_hazard"])
    # the outcomes that come later do not move what was forecast
    later = spark.createDataFrame([*weeks, ("a", weeks[-1][1] + dt.timedelta(7), "risk_off")], "series_id string, week date, state string")
    before = {(r.origin, r.model): r.p_change for r in rows.filter("horizon = 4").collect()}
    after = {(r.origin, r.model): r.p_change for r in transitions.prospective_hazards(later, 10, (4,)).collect()}
    assert all(after[k] == before[k] for k in after.keys() & before.keys()) and len(after.keys() & before.keys()) == 6

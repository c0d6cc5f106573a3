"""Joint forecasts and the ensemble against plain loops, and what may not enter them."""

import datetime as dt
import math
import random

import pytest

from tideline.operators import baselines, structural
from tideline.operators.labels import STATES

SCHEMA = "series_id string, origin date, target_week date, model string, current_state string, actual string, p_risk_on double, p_transition double, p_risk_off double, fallback boolean, fallback_reason string"
NAMES = ["markov", "class_prior", "hazard_destination"]
FIRST = dt.date(2019, 6, 7)


def experts(weeks=60, seed=3, step=1):
    draw, rows = random.Random(seed), []
    for s in "ab":
        for k in range(weeks):
            origin = FIRST + dt.timedelta(7 * k)
            now, actual = draw.choice(STATES), draw.choice(STATES)
            for m in NAMES:
                p = [draw.uniform(0.05, 1) + (m == "markov") * (x == actual) for x in STATES]
                fell = draw.random() < 0.08 or (s == "b" and k == 50)
                rows.append((s, origin, origin + dt.timedelta(7 * step), m, now, actual, *[x / sum(p) for x in p], fell, "made" if fell else ""))
    return rows


def plain(rows, half_life=10.0, least=8):
    out, at = {}, {}
    for r in rows:
        at.setdefault((r[0], r[1]), {})[r[3]] = r
    for (s, origin), now in at.items():
        past = [e for (t, _), e in at.items() if t == s and e["markov"][2] < origin and e["markov"][5] is not None and not any(x[9] for x in e.values())]
        loss = {m: sum(0.5 ** ((origin - e[m][2]).days / 7 / half_life) * -math.log(e[m][6 + STATES.index(e[m][5])]) for e in past) for m in NAMES}
        able = [m for m in NAMES if not now[m][9]]
        raw = {m: 0.0 if m not in able else 1.0 if len(past) < least else math.exp(min(loss[x] for x in able) - loss[m]) for m in NAMES}
        weight = {m: raw[m] / sum(raw.values()) if able else 0.0 for m in NAMES}
        p = [sum(weight[m] * now[m][6 + j] for m in NAMES) for j in range(3)] if able else [1 / 3] * 3
        out[s, origin] = (weight, loss, len(past), max((e["markov"][2] for e in past), default=None), p, not able)
    return out


@pytest.mark.parametrize("step", [1, 4])
def test_ensemble_equals_a_loop(spark, step):
    rows = experts(step=step)
    predictions, weights = structural.dynamic_ensemble(spark.createDataFrame(rows, SCHEMA), ["series_id"], NAMES, 10.0, 8)
    want = plain(rows)
    said = {(r.series_id, r.origin): r for r in predictions.collect()}
    assert said.keys() == want.keys() and sum(r.fallback for r in said.values()) == 1
    for k, (_, _, _, _, p, fallback) in want.items():
        assert [said[k][c] for c in structural.P] == pytest.approx(p, abs=1e-12) and said[k].fallback == fallback
        assert bool(said[k].fallback_reason) == fallback
    for r in weights.collect():
        weight, loss, n, latest, _, _ = want[r.series_id, r.origin]
        assert r.weight == pytest.approx(weight[r.expert], abs=1e-9) and r.discounted_log_loss == pytest.approx(loss[r.expert], abs=1e-9)
        assert (r.history_rows, r.latest_target, r.warmup) == (n, latest, n < 8)
        assert r.latest_target is None or r.latest_target < r.origin


def test_outcomes_at_or_after_an_origin_change_no_weight(spark):
    rows, at = experts(), FIRST + dt.timedelta(7 * 30)
    turned = [(*r[:5], STATES[(STATES.index(r[5]) + 1) % 3], *r[6:]) if r[2] >= at else r for r in rows]
    found = []
    for some in (rows, turned):
        _, weights = structural.dynamic_ensemble(spark.createDataFrame(some, SCHEMA), ["series_id"], NAMES, 10.0, 8)
        found.append({(r.series_id, r.origin, r.expert): r.weight for r in weights.collect()})
    early = {k for k in found[0] if k[1] <= at}
    assert all(found[0][k] == found[1][k] for k in early) and any(found[0][k] != found[1][k] for k in found[0].keys() - early)


def test_ensembles_refuse_what_cannot_be_compared(spark):
    rows = experts(weeks=4)
    for bad in (rows[1:], [*rows, rows[0]], [(*rows[0][:4], "other", *rows[0][5:]), *rows[1:]]):
        predictions, _ = structural.dynamic_ensemble(spark.createDataFrame(bad, SCHEMA), ["series_id"], NAMES)
        with pytest.raises(Exception, match="experts differ"):
            predictions.collect()
    with pytest.raises(Exception, match="half-lives"):
        structural.dynamic_ensemble(spark.createDataFrame(rows, SCHEMA), ["series_id"], NAMES, 0.001)[0].collect()
    for names, half_life, least in ((["markov"], 52.0, 26), (["markov", "markov"], 52.0, 26), (NAMES, 0.0, 26), (NAMES, 52.0, 0)):
        with pytest.raises(ValueError):
            structural.dynamic_ensemble(spark.createDataFrame(rows, SCHEMA), ["series_id"], names, half_life, least)
    predictions, weights = structural.dynamic_ensemble(spark.createDataFrame([], SCHEMA), ["series_id"], NAMES)
    assert predictions.count() == weights.count() == 0


HAZARD = "series_id string, origin date, horizon int, current_state string, actual_change boolean, p_change double, fallback boolean, fallback_reason string, calibration_fallback boolean"


def pair():
    base = [r for r in experts(weeks=12) if r[3] == "class_prior" and r[0] == "a"]
    hazards = [("a", r[1], 1, r[4], r[5] != r[4], 0.1 + 0.05 * k, k == 2, "few" if k == 2 else "", k == 3) for k, r in enumerate(base)]
    return base, hazards


def test_joint_forecasts_by_hand(spark):
    base, hazards = pair()
    base[0] = ("a", *base[0][1:4], "risk_on", "transition", 0.5, 0.5, 0.0, False, "")
    hazards[0] = ("a", base[0][1], 1, "risk_on", True, 0.2, False, "", False)
    out = structural.joint_forecasts(spark.createDataFrame(base, SCHEMA), spark.createDataFrame(hazards[:-1], HAZARD), ["series_id"]).orderBy("origin").collect()
    assert len(out) == len(base) - 1 and {r.model for r in out} == {structural.JOINT}
    assert [out[0][c] for c in structural.P] == pytest.approx([0.8, 0.2 * 0.5 / (0.5 + 1e-6), 0.2 * 1e-6 / (0.5 + 1e-6)])
    for r, b, h in zip(out, base, hazards, strict=False):
        assert sum(r[c] for c in structural.P) == pytest.approx(1.0) and r[f"p_{b[4]}"] == pytest.approx(1 - h[5])
        assert r.fallback == (b[9] or h[6] or h[8])
    assert "hazard:few" in out[2].fallback_reason


def test_pairs_that_do_not_fit(spark):
    base, hazards = pair()
    broken = {
        1: ("duplicate_forecast", None), 2: ("duplicate_hazard", None), 3: ("target_week", (2, 4)), 4: ("current_state", (3, "other")),
        5: ("outcome", (4, not hazards[5][4])), 6: ("p_change", (5, 1.0)), 7: ("p_change", (5, None)), 8: ("outcome", (4, None)),
    }
    base.append(base[1])
    hazards.append(hazards[2])
    for k, (_, change) in broken.items():
        if change:
            hazards[k] = (*hazards[k][: change[0]], change[1], *hazards[k][change[0] + 1 :])
    b, h = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(hazards, HAZARD)
    found = {r.origin: r.reason for r in structural.pairing_violations(b, h, ["series_id"]).collect()}
    assert found == {base[k][1]: reason for k, (reason, _) in broken.items()}
    with pytest.raises(Exception, match="forecast and hazard differ"):
        structural.joint_forecasts(b, h, ["series_id"]).collect()


def test_next_forecast_reads_nothing_later(spark):
    draw = random.Random(9)
    states = [(s, FIRST + dt.timedelta(7 * k), draw.choice(STATES)) for s, n in (("a", 40), ("b", 14)) for k in range(n)]
    schema, day = "series_id string, week date, state string", FIRST + dt.timedelta(7 * 20 + 3)
    later = [(s, w, STATES[0]) if w > day else (s, w, x) for s, w, x in states]
    rows = [baselines.forecast_next(spark.createDataFrame(x, schema), 15, str(day)).orderBy("series_id", "model").collect() for x in (states, later)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
    own = {r.model: r for r in rows[0] if r.series_id == "a"}
    assert {r.origin for r in own.values()} == {FIRST + dt.timedelta(7 * 20)} and {r.status for r in own.values()} == {"ok"}
    seen = [x for s, _, x in states if s == "a"]
    pairs = list(zip(seen[:19], seen[1:20], strict=True))
    mine = [b for a, b in pairs if a == seen[20]]
    assert [own["markov"][c] for c in structural.P] == pytest.approx([(mine.count(x) + 1) / (len(mine) + 3) for x in STATES])
    assert own["markov"].train_size == 19
    few = [r for r in rows[0] if r.series_id == "b"]
    assert {r.status for r in few} == {"not_enough_history:12<15"} and all(r.p_risk_on is None for r in few)
    assert baselines.forecast_next(spark.createDataFrame(states, schema), 15, "2000-01-01").count() == 0

"""Boosted hazards: what they may learn from, what they forecast, and the joint forecasts made of them."""

import datetime as dt
import math
import random

from tideline.operators import learned, structural, transitions
from tideline.operators.labels import STATES

FIRST, CUTOFF = dt.date(2015, 1, 2), "2018-01-05"
SCHEMA = "series_id string, week date, state string, signal double, noise double"
SMALL = {"maxIter": 10}


def made(weeks=220, seed=12):
    """States that are left the week after ``signal`` was high."""
    draw, rows = random.Random(seed), []
    for s in "ab":
        state = 0
        for k in range(weeks):
            signal = draw.random()
            rows.append((s, FIRST + dt.timedelta(7 * k), STATES[state], None if k % 19 == 3 else signal, draw.random()))
            if signal > 0.8:
                state = (state + draw.choice((1, 2))) % 3
    return rows


def test_boosted_hazards_learn_before_the_cutoff_only(spark):
    rows, cut = made(), dt.date.fromisoformat(CUTOFF)
    seen = {}
    for name, some in (("all", rows), ("later", [(s, w, STATES[0] if w > cut else x, a, b) for s, w, x, a, b in rows])):
        found = learned.boosted_hazards(spark.createDataFrame(some, SCHEMA), ["signal", "noise"], CUTOFF, (1, 4), **SMALL).collect()
        seen[name] = {(r.series_id, r.origin, r.horizon): r for r in found}
    own = seen["all"]
    assert len(own) == sum(len([1 for s, w, *_ in rows if w >= cut]) - 2 * h for h in (1, 4)) and not any(r.fallback for r in own.values())
    assert all(abs(r.p_change - seen["later"][k].p_change) < 1e-12 for k, r in own.items())
    state = {(s, w): x for s, w, x, *_ in rows}
    assert all(r.actual_change == any(state[s, w + dt.timedelta(7 * j)] != state[s, w] for j in range(1, h + 1)) for (s, w, h), r in own.items())
    one = [r for k, r in own.items() if k[2] == 1]
    loss = -sum(math.log(r.p_change if r.actual_change else 1 - r.p_change) for r in one) / len(one)
    share = sum(r.actual_change for r in one) / len(one)
    assert loss < 0.6 * -(share * math.log(share) + (1 - share) * math.log(1 - share))


def test_joint_forecasts_of_boosted_trees_and_hazards(spark):
    frame = spark.createDataFrame(made(), SCHEMA)
    base = learned.split_forecasts(frame, ["signal", "noise"], "elastic", CUTOFF)
    hazards = learned.boosted_hazards(frame, ["signal", "noise"], CUTOFF, (1,), **SMALL)
    assert structural.pairing_violations(base, hazards, ["series_id"]).count() == 0
    said = {(r.series_id, r.origin): r.p_change for r in hazards.collect()}
    joint = structural.joint_forecasts(base, hazards, ["series_id"]).collect()
    assert len(joint) == len(said)
    assert all(abs(1 - r[f"p_{r.current_state}"] - said[r.series_id, r.origin]) < 1e-9 for r in joint)
    calibrated = learned.platt(transitions.with_split(hazards, "2018-09-07"), ["series_id", "horizon", "model"])
    assert calibrated.count() > 0


def test_few_events_fall_back(spark):
    rows = [("a", FIRST + dt.timedelta(7 * k), STATES[0], 0.5, 0.5) for k in range(200)]
    found = learned.boosted_hazards(spark.createDataFrame(rows, SCHEMA), ["signal", "noise"], CUTOFF, (1,), **SMALL).collect()
    n = sum(w + dt.timedelta(7) < dt.date.fromisoformat(CUTOFF) for _, w, *_ in rows)
    assert found and all(r.fallback and abs(r.p_change - 1 / (n + 2)) < 1e-12 for r in found)
    assert learned.boosted_hazards(spark.createDataFrame([], SCHEMA), ["signal", "noise"], CUTOFF, (1,), **SMALL).count() == 0

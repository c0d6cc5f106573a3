"""Learned candidates against their conditions of optimality and against prefixes of the data."""

import datetime as dt
import math

import numpy as np
import pytest

from tideline.operators import discriminant, learned
from tideline.operators.labels import STATES


def panel(n=90, seed=7):
    draw, rows, state = np.random.default_rng(seed), [], 1
    for k in range(n):
        if draw.random() < 0.15:
            state = int(np.clip(state + draw.choice([-1, 1]), 0, 2))
        score = 1.0 - state + draw.normal(0, 0.3)
        rows.append(("a", dt.date(2020, 1, 3) + dt.timedelta(7 * k), STATES[state], float(score), None if k % 17 == 0 else float(draw.normal())))
    return rows


SCHEMA = "series_id string, week date, state string, score double, noise double"


def test_logistic_is_at_its_optimum():
    draw = np.random.default_rng(1)
    x, y, c = draw.normal(size=(80, 3)), draw.integers(0, 3, 80), 0.1
    w = learned.multinomial(x, y, 3, c)
    loss = lambda v: (v[:, 1:] ** 2).sum() / 2 - c * np.log(learned.softmax(np.column_stack([np.ones(80), x]) @ v.T)[np.arange(80), y]).sum()
    for _ in range(50):
        assert loss(w) <= loss(w + draw.normal(0, 0.02, w.shape)) + 1e-9
    assert np.allclose(learned.multinomial(x, y, 3, c, w), w, atol=1e-6)


def test_design_uses_training_rows_only():
    train = np.array([[1.0, np.nan], [3.0, 5.0], [5.0, 7.0]])
    a, b = learned.design(train, np.array([[np.nan, np.nan], [3.0, np.inf]]))
    assert a.shape == (3, 3) and np.allclose(a.mean(axis=0), 0)
    assert b[0, 0] == 0 and np.allclose(b[0, 1:], b[1, 1:])


def test_forecasts_do_not_see_later_rows(spark):
    rows = panel()
    whole = spark.createDataFrame(rows, SCHEMA)
    out = {(r.origin, r.model): r for r in learned.walk_forward(whole, ["score", "noise"], 40).collect()}
    assert len(out) == 2 * (len(rows) - 1 - 41) and all(math.isclose(sum(r[f"p_{s}"] for s in STATES), 1, abs_tol=1e-9) for r in out.values())
    changed = [r if k <= 60 else (*r[:3], 99.0, 99.0) for k, r in enumerate(rows)]
    later = {(r.origin, r.model): r for r in learned.walk_forward(spark.createDataFrame(changed, SCHEMA), ["score", "noise"], 40).collect()}
    for key, r in out.items():
        if r.pos <= 60:
            assert all(math.isclose(r[f"p_{s}"], later[key][f"p_{s}"], abs_tol=1e-9) for s in STATES)
    own = [r for r in out.values() if r.model == "ridge_logistic"]
    hits = np.mean([max(STATES, key=lambda s: r[f"p_{s}"]) == r.actual for r in own])
    assert hits > 0.5 and not any(r.fallback for r in own)
    # the pair of the week before the origin is purged
    flipped = [r if k != 60 else (*r[:2], "risk_off" if r[2] != "risk_off" else "risk_on", *r[3:]) for k, r in enumerate(rows)]
    moved = {(r.pos, r.model): r for r in learned.walk_forward(spark.createDataFrame(flipped, SCHEMA), ["score", "noise"], 40).collect()}
    before = {(r.pos, r.model): r for r in out.values()}
    assert moved[(60, "ridge_logistic")].p_risk_on == before[(60, "ridge_logistic")].p_risk_on
    assert moved[(62, "ridge_logistic")].p_risk_on != before[(62, "ridge_logistic")].p_risk_on


def test_one_class_and_empty_tables_fall_back(spark):
    rows = [("a", dt.date(2020, 1, 3) + dt.timedelta(7 * k), "risk_on", 1.0, None) for k in range(30)]
    out = learned.walk_forward(spark.createDataFrame(rows, SCHEMA), ["score", "noise"], 10).collect()
    assert out and all(r.fallback and r.p_risk_on > r.p_risk_off > 0 for r in out)
    assert learned.walk_forward(spark.createDataFrame([], SCHEMA), ["score", "noise"], 10).count() == 0
    assert learned.hazards(spark.createDataFrame(rows[:5], SCHEMA), ["score", "noise"], 10).count() == 0


def test_hazards_platt_and_embargo(spark):
    raw = learned.hazards(spark.createDataFrame(panel(140), SCHEMA), ["score", "noise"], 40, (1, 4))
    rows = raw.collect()
    assert {r.horizon for r in rows} == {1, 4} and all(0 < r.p_change < 1 for r in rows)
    states = [r[2] for r in panel(140)]
    weeks = {r[1]: k for k, r in enumerate(panel(140))}
    assert all(r.actual_change == any(states[weeks[r.origin] + j] != states[weeks[r.origin]] for j in range(1, r.horizon + 1)) for r in rows)
    out = sorted(learned.platt(raw, ["series_id", "horizon", "model"]).filter("horizon = 4").collect(), key=lambda r: r.origin)
    assert all(r.calibration_fallback for r in out[:29]) and not out[-1].calibration_fallback
    assert all(r.p_calibrated == r.p_change for r in out if r.calibration_fallback)
    # the last one against a fit over all forecasts that were over before it
    past = [r for r in out if r.origin + dt.timedelta(28) < out[-1].origin]
    logit = lambda p: math.log(p / (1 - p))
    w = learned.multinomial(np.array([[logit(r.p_change)] for r in past]), np.array([int(r.actual_change) for r in past]), 2, learned.PLATT_C)
    want = learned.softmax(np.array([[1.0, logit(out[-1].p_change)]]) @ w.T)[0, 1]
    assert math.isclose(out[-1].p_calibrated, want, abs_tol=1e-6)
    split = learned.embargoed(raw, "2021-06-04").collect()
    cut = dt.date(2021, 6, 4)
    assert {r.evaluation_split for r in split} == {"selection", "diagnostic"}
    for r in split:
        end = r.origin + dt.timedelta(7 * r.horizon)
        assert end < cut if r.evaluation_split == "selection" else r.origin >= cut
    assert len(rows) - len(split) == 1 + 4


def test_split_models_learn_from_the_selection_rows(spark):
    frame = spark.createDataFrame(panel(160), SCHEMA)
    for kind in ("elastic", "forest", "boosted"):
        out = learned.split_forecasts(frame, ["score", "noise"], kind, "2022-01-07").collect()
        assert out and all(str(r.origin) >= "2022-01-07" and not r.fallback for r in out)
        assert all(math.isclose(sum(r[f"p_{s}"] for s in STATES), 1, abs_tol=1e-9) for r in out)
        assert np.mean([max(STATES, key=lambda s: r[f"p_{s}"]) == r.actual for r in out]) > 0.5


@pytest.mark.parametrize("rows_of_a_task", [20_000, 50])
def test_partitions_of_a_fit_follow_its_rows(spark, monkeypatch, rows_of_a_task):
    class Seen(Exception):
        pass

    class Pipeline:
        def fit(self, train):
            kept = train.persist()
            try:
                raise Seen(kept.rdd.getNumPartitions(), kept.count())
            finally:
                kept.unpersist()

    monkeypatch.setattr(learned, "split_pipeline", lambda *_: Pipeline())
    monkeypatch.setattr(learned, "FIT_ROWS", rows_of_a_task)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        with pytest.raises(Seen) as seen:
            learned.split_forecasts(spark.createDataFrame(panel(160), SCHEMA), ["score", "noise"], "boosted", "2022-01-07")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    partitions, rows = seen.value.args
    assert rows > 100 and partitions == math.ceil(rows / rows_of_a_task)


def test_hurdle_moves_to_neighbours_only(spark):
    rows = panel(150, seed=11)
    whole = spark.createDataFrame(rows, SCHEMA)
    out = {r.pos: r for r in learned.hurdle(whole, ["score", "noise"], 50).collect()}
    assert sorted(out) == list(range(51, 149))
    for r in out.values():
        assert math.isclose(r.p_risk_on + r.p_transition + r.p_risk_off, 1, abs_tol=1e-9)
        assert math.isclose(r.p_change, 1 - r[f"p_{r.current_state}"], abs_tol=1e-9)
        if r.current_state != "transition":
            assert r[f"p_{'risk_off' if r.current_state == 'risk_on' else 'risk_on'}"] == 0
    changed = [r if k <= 80 else (*r[:3], -5.0, 5.0) for k, r in enumerate(rows)]
    later = {r.pos: r for r in learned.hurdle(spark.createDataFrame(changed, SCHEMA), ["score", "noise"], 50).collect()}
    assert all(math.isclose(later[k].p_change, out[k].p_change, abs_tol=1e-7) for k in range(51, 81))
    still = [(*r[:2], "risk_on", *r[3:]) for r in rows[:70]]
    flat = learned.hurdle(spark.createDataFrame(still, SCHEMA), ["score", "noise"], 50).collect()
    assert {r.fallback_reason for r in flat} == {"hazard_class_missing;destination_class_missing"}
    assert all(math.isclose(r.p_change, 1 / (r.train_size + 2)) and math.isclose(r.p_transition, r.p_change) for r in flat)


def plain_discriminant(rows, y, x):
    """A refit over the rows: per-class shrinkage in units of deviations, pooled by shares."""
    shares, means, pooled = {}, {}, 0
    for k in np.unique(y):
        own = rows[y == k]
        n, p = own.shape
        means[k], shares[k] = own.mean(axis=0), n / len(rows)
        scale = own.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = (own - means[k]) / scale
        emp = z.T @ z / n
        mu = np.trace(emp) / p
        target = mu * np.eye(p)
        spread = ((emp - target) ** 2).sum() / p
        noise = sum(((np.outer(r, r) - emp) ** 2).sum() for r in z) / (n * n * p)
        intensity = 0 if spread == 0 else min(noise, spread) / spread
        pooled = pooled + shares[k] * ((1 - intensity) * emp + intensity * target) * np.outer(scale, scale)
    scores = np.full(3, -np.inf)
    for k, m in means.items():
        c = np.linalg.lstsq(pooled, m, rcond=None)[0]
        scores[k] = c @ x - m @ c / 2 + np.log(shares[k])
    e = np.exp(scores - scores.max())
    p = np.clip(e / e.sum(), 1e-9, 1)
    return p / p.sum()


def test_discriminant_equals_a_refit_at_every_origin(spark):
    rows = panel(120)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.pos: r for r in discriminant.walk_forward(frame, ["score", "noise"], 40, block=16).collect()}
    assert sorted(got) == list(range(41, 119))
    y = np.array([STATES.index(r[2]) for r in rows[1:]])
    x = np.array([[r[3], np.nan if r[4] is None else r[4]] for r in rows])
    for pos, r in got.items():
        use = [k for k in range(pos - 1) if np.isfinite(x[k]).all()]
        assert r.train_size == len(use) and r.fallback == bool(pos % 17 == 0)
        if not r.fallback:
            assert np.allclose([r[f"p_{s}"] for s in STATES], plain_discriminant(x[use], y[use], x[pos]), atol=1e-7)
    one_block = {r.pos: r for r in discriminant.walk_forward(frame, ["score", "noise"], 40, block=500).collect()}
    assert all(math.isclose(got[k].p_risk_on, one_block[k].p_risk_on, abs_tol=1e-8) for k in got)
    assert discriminant.walk_forward(frame.limit(0), ["score", "noise"], 40).count() == 0


def test_shrinkage_intensity():
    draw = np.random.default_rng(2)
    for n, p in ((8, 5), (400, 3)):
        x = draw.normal(size=(n, p)) @ draw.normal(size=(p, p)) + 3
        own = discriminant.Moments(p)
        for row in x:
            own.add(row)
        mean, cov, intensity = own.shrunk()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        emp = z.T @ z / n
        noise = sum(((np.outer(r, r) - emp) ** 2).sum() for r in z) / (n * n)
        want = min(1.0, noise / ((emp - np.eye(p)) ** 2).sum())
        assert np.allclose(mean, x.mean(axis=0)) and math.isclose(intensity, want, rel_tol=1e-6)
        assert np.allclose(cov, ((1 - want) * emp + want * np.eye(p)) * np.outer(x.std(axis=0), x.std(axis=0)), rtol=1e-6)


def test_blocks_of_origins_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(panel(100), SCHEMA)
    keyed = lambda df, *k: {tuple(r[c] for c in k): r.p_risk_on if "p_risk_on" in r else r.p_change for r in df.collect()}
    runs = []
    for block in (1000, 16):
        monkeypatch.setattr(learned, "ORIGINS", block)
        runs.append(
            keyed(learned.walk_forward(frame, ["score", "noise"], 40), "origin", "model")
            | keyed(learned.hurdle(frame, ["score", "noise"], 40), "origin", "model")
            | keyed(learned.hazards(frame, ["score", "noise"], 40, (1, 4)), "origin", "model", "horizon")
        )
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 2 * 58 + 58 + 58 + 52
    assert all(math.isclose(runs[0][k], runs[1][k], abs_tol=1e-6) for k in runs[0])

import datetime as dt
import math

import numpy as np

from tideline.operators import metrics, nowcast, selection
from tideline.operators.labels import STATES
from tideline.sources import snapshots


def _by_cells(evidence):
    """The filter cell by cell, weeks counted from 1."""
    def hazard(state, weeks):
        return 0.0 if weeks < 2 else min(0.45, (0.18 if state == "transition" else 0.04) + 0.01 * (weeks - 2))

    out, cells = [], {}
    for t, seen in enumerate(evidence):
        new = {}
        for (state, weeks), mass in cells.items():
            leave = mass * hazard(state, weeks)
            later = (state, min(26, weeks + 1))
            new[later] = new.get(later, 0.0) + mass - leave
            ways = ["risk_on", "risk_off"] if state == "transition" else ["transition"]
            for to in ways:
                new[(to, 1)] = new.get((to, 1), 0.0) + leave / len(ways)
        if not t:
            new = {(s, 1): 1 / 3 for s in STATES}
        new = {(s, w): m * seen[STATES.index(s)] for (s, w), m in new.items()}
        total = sum(new.values())
        cells = {k: m / total for k, m in new.items()}
        out.append([sum(m for (s, _), m in cells.items() if s == state) for state in STATES])
    return out


def test_duration_filter_equals_its_cells(spark):
    draw = np.random.default_rng(3)
    evidence = draw.dirichlet([0.4] * 3, size=60)
    rows = [("a", dt.date(2020, 1, 3) + dt.timedelta(7 * t), *map(float, e)) for t, e in enumerate(evidence)]
    rows += [("a", dt.date(2030, 1, 4), None, 0.5, 0.5), ("b", dt.date(2020, 1, 3), 1.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "series_id string, week date, p_risk_on double, p_transition double, p_risk_off double")
    found = sorted(nowcast.duration_filter(frame).collect(), key=lambda r: (r.series_id, r.week))
    assert len(found) == 61
    floored = np.maximum(evidence, 1e-9)
    for row, want in zip(found, _by_cells(floored / floored.sum(axis=1, keepdims=True)), strict=False):
        assert all(math.isclose(row[f"p_{s}"], w, abs_tol=1e-9) for s, w in zip(STATES, want, strict=True))
    states = [r.state for r in found if r.series_id == "a"]
    assert not any({a, b} == {"risk_on", "risk_off"} for a, b in zip(states, states[1:], strict=False))
    shorter = nowcast.duration_filter(frame.filter("week < DATE '2020-06-01'")).filter("series_id = 'a'").orderBy("week").collect()
    assert [r.p_risk_on for r in shorter] == [r.p_risk_on for r in found[: len(shorter)]]
    assert nowcast.duration_filter(frame.limit(0)).count() == 0


def test_bootstrap_equals_single_resamples(spark):
    values = np.random.default_rng(5).normal(0.05, 1, 30)
    rows = [("x", "m", k, float(v)) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "series_id string, model string, origin int, improvement double")
    (row,) = selection.block_bootstrap(frame, ["series_id"], "model", "origin", resamples=200).collect()
    starts = np.random.default_rng(17).integers(0, 30, size=(200, 3))
    hits = 0
    for own in starts:
        sample = [values[(s + d) % 30] - values.mean() for s in own for d in range(13)][:30]
        hits += np.mean(sample) >= values.mean() - 1e-12
    assert row.n == 30 and math.isclose(row.p, (1 + hits) / 201)


def test_vintages_keep_tombstones(spark):
    wide = spark.createDataFrame([(dt.date(2020, 1, 1), {"A_20200103": "1.5", "A_B_20200104": ".", "junk": "1"}), (dt.date(2020, 2, 1), None)], "period date, cells map<string,string>")
    rows = {(r.series_id, r.vintage_date): r.value for r in snapshots.unpivot_vintages(wide).collect()}
    assert rows == {("A", dt.date(2020, 1, 3)): 1.5, ("A_B", dt.date(2020, 1, 4)): None}


def test_snapshots_show_after_their_commit_row(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([("a", 1.0), ("b", None)], "series_id string, value double")
    snapshots.append_snapshot(rows, root, "one", {"source": "x", "token": "abc", "url": "http://h/?api_key=k&y=1"})
    snapshots.stage_rows(rows, root, "two")
    taken, seen = snapshots.committed(spark, root, "series_id string, value double")
    assert {(r.snapshot_id, r.series_id, r.value) for r in seen.collect()} == {("one", "a", 1.0), ("one", "b", None)}
    values = {r.name: r.value for r in taken.collect()}
    assert values["source"] == "x" and values["token"] == "[redacted]" and "k&" not in values["url"]
    try:
        snapshots.append_snapshot(rows, root, "one", {})
        raise AssertionError("a committed snapshot was changed")
    except ValueError:
        pass
    snapshots.append_snapshot(rows.limit(0), root, "two", {"source": "x"})
    assert snapshots.committed(spark, root, "series_id string, value double")[1].filter("snapshot_id = 'two'").count() == 0


def test_sign_test_of_blocks(spark):
    day = lambda k: dt.date(2024, 1, 5) + dt.timedelta(7 * k)
    # seven blocks of three weeks and one of one: six above 0, one below, one at 0
    means = [1, 1, 1, 1, 1, 1, -1, 0]
    rows = [("s", "a", day(k), float(means[k // 3])) for k in range(22)] + [("s", "b", day(k), -1.0) for k in range(22)] + [("s", "c", day(k), 0.0) for k in range(22)]
    frame = spark.createDataFrame(rows, "series_id string, model string, origin date, improvement double")
    got = {r.model: (r.blocks, r.better, round(r.p, 9)) for r in selection.block_sign_test(frame, ["series_id"], "model", "origin", 3).collect()}
    assert got == {"a": (7, 6, round((7 + 1) / 2**7, 9)), "b": (8, 0, 1.0), "c": (0, 0, 1.0)}
    assert selection.block_sign_test(frame.limit(0), ["series_id"], "model", "origin").count() == 0


def test_a_candidate_that_fell_back_is_none(spark):
    rows = [("s", "majority", 1.0, 0.1, 5), ("s", "good", 0.5, 0.1, 1), ("s", "fair", 0.8, 0.1, 0)]
    board = spark.createDataFrame(rows, "series_id string, model string, log_loss double, calibration_error double, fallback_count long")
    pick = lambda b: metrics.select_champion(b, ["series_id"], ["majority"], {"good": 1, "fair": 2}).first()["champion"]
    assert pick(board) == "fair" and pick(board.drop("fallback_count")) == "good"

"""Hand-written values of single operators, so that a query and its SQL cannot share a mistake."""

import datetime as dt
import math

import pytest

from tideline.operators import features, labels, metrics, selection

WEEK0 = dt.date(2024, 1, 5)


def week(k):
    return WEEK0 + dt.timedelta(7 * k)


def test_bank_credit_ratios_are_to_total_loans(spark):
    rows = [("s", week(0), 1000.0, 200.0, 1500.0, 90_000.0), ("s", week(1), 1100.0, 220.0, 1540.0, None), ("s", week(2), 0.0, 5.0, 7.0, 9.0)]
    frame = spark.createDataFrame(rows, "series_id string, week date, total_loans double, business_loans double, deposits double, borrowings double")
    a, b, c = features.bank_credit(frame).orderBy("week").collect()
    assert (a.business_share, a.deposit_ratio, a.borrowing_ratio, a.coverage) == (0.2, 1.5, 0.09, 1.0)
    assert (round(b.deposit_ratio, 12), b.borrowing_ratio, b.coverage) == (1.4, None, 0.75)
    assert c.business_share is None and c.deposit_ratio is None and c.borrowing_ratio is None


def releases(spark, values, months):
    rows = [("s", week(k), v, dt.date(2024, m, 1)) for k, (v, m) in enumerate(zip(values, months, strict=True))]
    frame = spark.createDataFrame(rows, "series_id string, week date, value double, observed_period date")
    return features.release_innovation(frame).orderBy("week").collect()


def test_release_innovation_by_hand(spark):
    # changes at new periods: 2, 4, 6, 8; then a revision of the last period by -3
    values = [50.0, 50.0, 52.0, 52.0, 56.0, 62.0, 62.0, 70.0, 67.0, 67.0, 71.0]
    months = [1, 1, 2, 2, 3, 4, 4, 5, 5, 5, 6]
    out = releases(spark, values, months)
    assert [r.event for r in out] == [0, 0, 1, 0, 1, 1, 0, 1, 1, 0, 1]
    assert [r.period_change for r in out] == [0, 0, 1, 0, 1, 1, 0, 1, 0, 0, 1]
    assert [r.revision_event for r in out] == [0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]
    assert [r.prior_event_count for r in out] == [0, 0, 0, 1, 1, 2, 3, 3, 4, 5, 5]
    assert [r.coverage for r in out] == [0, 0, 0, 0.25, 0.25, 0.5, 0.75, 0.75, 1, 1, 1]
    assert out[7].expected is None and out[7].standardized is None and out[7].delta == 8
    # the median of 2, 4, 6, 8 is 5, their deviations are 3, 1, 1, 3
    assert (out[8].delta, out[8].expected) == (-3.0, 5.0)
    assert math.isclose(out[8].scale, 1.4826 * 2) and math.isclose(out[8].standardized, -8 / (1.4826 * 2))
    assert (out[9].delta, out[9].expected, out[9].scale, out[9].standardized) == (0, 0, 0, 0)


def test_release_innovation_keeps_twelve_events(spark):
    values, months = [float(k * k) for k in range(20)], [1 + k % 12 for k in range(20)]
    out = releases(spark, values, months)
    assert [r.prior_event_count for r in out] == [0, *[min(k, 12) for k in range(19)]]
    deltas = sorted(2 * k - 1 for k in range(7, 19))
    assert out[19].expected == (deltas[5] + deltas[6]) / 2
    assert [tuple(r) for r in releases(spark, values[:10], months[:10])] == [tuple(r) for r in out[:10]]


def test_distance_by_state_is_signed(spark):
    rows = [("s", week(0), 1.5, "risk_on", -1.0, 1.0), ("s", week(1), 0.5, "risk_on", -1.0, 1.0), ("s", week(2), -1.5, "risk_off", -1.0, 1.0), ("s", week(3), 0.2, "transition", -1.0, 1.0)]
    rows += [("s", week(4), 1.2, "transition", -1.0, 1.0), ("s", week(5), None, "transition", -1.0, 1.0)]
    frame = spark.createDataFrame(rows, "series_id string, week date, risk_score double, state string, lower double, upper double")
    out = features.transition_path(frame).orderBy("week").collect()
    rounded = lambda x: None if x is None else round(x, 9)
    assert [rounded(r.state_distance) for r in out] == [0.25, -0.25, 0.25, 0.4, -0.1, None]
    assert [rounded(r.nearest_boundary) for r in out] == [0.25, 0.25, 0.25, 0.4, 0.1, None]


def events(spark, groups):
    rows = [(g, y, p) for g, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(rows, "g string, actual_change boolean, p_change double")


def test_threshold_falls_back_to_one_half(spark):
    groups = {"few": [(True, 0.9), (False, 0.1)], "one class": [(False, 0.2)] * 40, "good": [(True, 0.32), (False, 0.28)] * 20}
    out = {r.g: (r.threshold, r.balanced_accuracy) for r in metrics.best_threshold(events(spark, groups), ["g"]).collect()}
    assert out["few"] == (0.5, None) and out["one class"] == (0.5, None)
    assert out["good"] == (0.32, 1.0)


def test_holm_against_a_loop(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.6, "e": 0.03}
    out = {r.model: r.p_holm for r in metrics.holm(spark.createDataFrame([("k", m, v) for m, v in p.items()], "key string, model string, p double"), ["key"]).collect()}
    top, want = 0.0, {}
    for rank, (model, value) in enumerate(sorted(p.items(), key=lambda x: (x[1], x[0]))):
        top = max(top, min(1.0, value * (len(p) - rank)))
        want[model] = top
    assert out == pytest.approx(want)


def test_gates_against_a_plain_version(spark):
    board = [("majority", 1.0, 0.5, 0.1), ("markov", 0.9, 0.45, 0.05), ("far", 0.86, 0.45, 0.1), ("good", 0.80, 0.44, 0.1), ("simple", 0.805, 0.45, 0.1), ("blurred", 0.7, 0.47, 0.1), ("lucky", 0.6, 0.4, 0.1), ("broken", 0.5, 0.3, 0.1)]
    rows = [("k", m, ll, br, ce, 3 if m == "broken" else 0) for m, ll, br, ce in board]
    frame = spark.createDataFrame(rows, "key string, model string, log_loss double, brier double, calibration_error double, fallback_count int")
    pvalues = spark.createDataFrame([("k", m, 0.5 if m == "lucky" else 0.001) for m, *_ in board[2:]], "key string, model string, p double")
    out = {r.model: r for r in selection.gated_champion(frame, pvalues, ["key"], ["majority", "markov"], {"simple": 1, "good": 2, "blurred": 3}).collect()}
    assert {m: r.gate_reason for m, r in out.items()} == {"far": "gain", "good": "passed", "simple": "passed", "blurred": "brier", "lucky": "p_value", "broken": "fallbacks"}
    assert {r.reference for r in out.values()} == {"markov"} and [m for m, r in out.items() if r.selected] == ["simple"]


def test_bootstrap_refuses_unequal_or_missing_improvements(spark):
    schema = "key string, model string, origin int, improvement double"
    rows = [("k", m, o, 0.1) for m in ("a", "b") for o in range(20)]
    for bad in ([*rows, ("k", "a", 99, 0.2)], [*rows[:-1], ("k", "b", 19, None)]):
        with pytest.raises(Exception, match="equal lengths|finite"):
            selection.block_bootstrap(spark.createDataFrame(bad, schema), ["key"], "model", "origin", resamples=50).collect()
    same = selection.block_bootstrap(spark.createDataFrame(rows, schema), ["key"], "model", "origin", resamples=50).collect()
    assert len({r.p for r in same}) == 1


def test_label_statistics_use_training_weeks_only(spark):
    rows = [("s", week(k), 100 + 10 * math.sin(k / 5) + k % 7) for k in range(160)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "series_id string, week date, price double, volume double")
    whole = labels.fitted(frame, 104)
    cut = labels.fitted(frame.filter(f"week <= DATE '{week(120)}'"), 104)
    for name in ("parts", "whole", "limits"):
        assert whole[name].collect() == cut[name].collect()
    early = {r.week: r.risk_score for r in cut["scores"].collect()}
    assert early == {r.week: r.risk_score for r in whole["scores"].collect() if r.week in early}

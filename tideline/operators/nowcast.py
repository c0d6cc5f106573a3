"""Explicit-duration filter of state evidence.

The posterior is a table of states by weeks in the state. A week moves each cell's mass one week on, or out of the state
with a hazard that grows with the time in it; the extremes reach each other only by way of the middle state. Weeks are
sequential by nature, so one series is one group; a group holds its weeks only, whatever the number of series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tideline.operators.labels import STATES

#: Fixed values of the filter.
MAX_WEEKS = 26
MIN_WEEKS = 2
BASE_HAZARD = {"risk_on": 0.04, "transition": 0.18, "risk_off": 0.04}
HAZARD_SLOPE = 0.01
MAX_HAZARD = 0.45
EMISSION_FLOOR = 1e-9

MIDDLE = STATES.index("transition")
#: Share of a state's leavers that goes to each state.
ROUTES = np.array([[0.0, 1.0, 0.0], [0.5, 0.0, 0.5], [0.0, 1.0, 0.0]])


def exit_hazards() -> np.ndarray:
    """Chance of leaving by state and weeks in it."""
    weeks = np.arange(1, MAX_WEEKS + 1)
    base = np.array([BASE_HAZARD[s] for s in STATES])[:, None]
    return np.where(weeks < MIN_WEEKS, 0.0, np.minimum(MAX_HAZARD, base + HAZARD_SLOPE * (weeks - MIN_WEEKS)))


def _filtered(evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities and the chance of having just switched, week by week."""
    hazard, cells = exit_hazards(), np.zeros((len(STATES), MAX_WEEKS))
    found, switched = np.empty_like(evidence), np.zeros(len(evidence))
    for t, seen in enumerate(evidence):
        arrived = np.full(len(STATES), 1 / len(STATES)) if t == 0 else (cells * hazard).sum(axis=1) @ ROUTES
        stayed, moved = cells * (1 - hazard), np.zeros_like(cells)
        moved[:, 1:] = stayed[:, :-1]
        moved[:, -1] += stayed[:, -1]
        moved[:, 0] = arrived
        cells = moved * seen[:, None]
        mass = cells.sum()
        switched[t] = (arrived * seen).sum() / mass if t else 0.0
        cells /= mass
        found[t] = cells.sum(axis=1)
    return found, switched


def duration_filter(emissions: DataFrame, key: str = "series_id", week: str = "week") -> DataFrame:
    """(key, week, p_*, raw_state, state, duration_weeks, state_changed, confidence, p_switch) of (key, week, p_*).

    Weeks without evidence in all three columns are left out. A shown jump between the extremes goes through the middle.
    """
    columns = [f"p_{s}" for s in STATES]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(week).reset_index(drop=True)
        evidence = np.maximum(frame[columns].to_numpy(float), EMISSION_FLOOR)
        found, switched = _filtered(evidence / evidence.sum(axis=1, keepdims=True))
        raw, shown, lasted = found.argmax(axis=1), [], []
        for now in raw.tolist():
            last = shown[-1] if shown else None
            state = MIDDLE if last is not None and {last, now} == {0, 2} else now
            lasted.append(lasted[-1] + 1 if state == last else 1)
            shown.append(state)
        out = frame[[key, week]].copy()
        out[columns] = found
        out["raw_state"], out["state"] = [STATES[k] for k in raw], [STATES[k] for k in shown]
        out["duration_weeks"] = lasted
        out["state_changed"] = [k > 0 and shown[k] != shown[k - 1] for k in range(len(shown))]
        out["confidence"], out["p_switch"] = found.max(axis=1), switched
        return out

    types = dict(emissions.dtypes)
    schema = f"{key} {types[key]}, {week} {types[week]}, " + ", ".join(f"{c} double" for c in columns)
    schema += ", raw_state string, state string, duration_weeks long, state_changed boolean, confidence double, p_switch double"
    return emissions.select(key, week, *columns).dropna(subset=columns).groupBy(key).applyInPandas(run, schema)

"""Online upkeep of laws with Structured Streaming.

Windows are of rows, in order of t, per series. The current law is x' = r x; a window whose fit by the current law is off by more than
limit times the scale of the fit, for patience windows in a row, gives a new one and a change record. Input must strictly
increase in t within a series; what doesn't is refused, not reordered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..frames import KEY, TIME


def rate(t: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """r of x' = r x by least squares over central slopes, and the root mean square of what is left, with a floor."""
    d = np.gradient(v, t)[1:-1]
    x = v[1:-1]
    r = float((d * x).sum() / max((x * x).sum(), 1e-300))
    return r, max(float(np.sqrt(((d - r * x) ** 2).mean())), 1e-3 * max(1.0, float(np.sqrt((v * v).mean()))))


def ranges(n: int, width: int, step: int, growing: bool = False) -> list[tuple[int, int]]:
    """Sliding windows of rows; growing: also those that begin at 0 before width rows are there."""
    out = [(0, e) for e in range(step, width, step)] if growing else []
    return out + [(s, s + width) for s in range(0, n - width + 1, step)]


class Tracker:
    """The law of one series as rows come in; its state is JSON, so that a query can be taken up again."""

    def __init__(self, width: int = 32, step: int = 16, limit: float = 3.0, patience: int = 2, state: str | None = None):
        self.width, self.step, self.limit, self.patience = width, step, limit, patience
        self.s = json.loads(state) if state else {"t": [], "v": [], "rate": None, "scale": None, "streak": 0, "window": 0, "seen": None}

    def state(self) -> str:
        return json.dumps(self.s)

    def add(self, t: np.ndarray, v: np.ndarray) -> list[dict]:
        s = self.s
        if len(t) and (np.any(np.diff(t) <= 0) or (s["seen"] is not None and t[0] <= s["seen"])):
            raise ValueError("t must strictly increase")
        s["t"] += t.tolist()
        s["v"] += v.tolist()
        s["seen"] = s["t"][-1] if s["t"] else s["seen"]
        out = []
        while len(s["t"]) >= self.width:
            wt, wv = np.array(s["t"][: self.width]), np.array(s["v"][: self.width])
            if s["rate"] is None:
                s["rate"], s["scale"] = rate(wt, wv)
            d = np.gradient(wv, wt)[1:-1]
            drift = float(np.sqrt(((d - s["rate"] * wv[1:-1]) ** 2).mean())) / s["scale"]
            s["streak"] = s["streak"] + 1 if drift > self.limit else 0
            if s["streak"] >= self.patience:
                old = s["rate"]
                s["rate"], s["scale"] = rate(wt, wv)
                s["streak"] = 0
                out.append({"window": s["window"], "start_t": float(wt[0]), "end_t": float(wt[-1]), "drift": drift, "old_rate": old, "new_rate": s["rate"]})
            s["window"] += 1
            s["t"], s["v"] = s["t"][self.step :], s["v"][self.step :]
        return out


_OUT = "series_id string, window long, start_t double, end_t double, drift double, old_rate double, new_rate double"


def changes(df: DataFrame, column: str, **options) -> DataFrame:
    """Change records of a batch frame: the same windows as the streaming query sees."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        found = Tracker(**options).add(g[TIME].to_numpy(), g[column].to_numpy())
        return pd.DataFrame([{KEY: g[KEY].iloc[0], **r} for r in found], columns=[c.split()[0] for c in _OUT.split(", ")])

    return df.select(KEY, TIME, column).groupBy(KEY).applyInPandas(run, _OUT)


def track(stream: DataFrame, column: str, **options) -> DataFrame:
    """Change records of a streaming frame, one state a series."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker(**options, state=state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(TIME)
        found = tracker.add(rows[TIME].to_numpy(), rows[column].to_numpy())
        state.update((tracker.state(),))
        if found:
            yield pd.DataFrame([{KEY: key[0], **r} for r in found])

    return stream.select(KEY, TIME, column).groupBy(KEY).applyInPandasWithState(run, _OUT, "state string", "append", "NoTimeout")

"""Laws kept up to date as rows come in: found on a first window, found anew when later windows drift from them for long.

Windows count rows, not time; they tumble unless step is smaller. A law is tried on a window by integrating it from the window's
first row; its drift is the largest ratio, over the states, of what is left to what was left where the law was found. Like input gives
like records, and the state between batches is JSON. It is a batch discovery run again on a window, not incremental learning.
A row that is not later than the last one is an error, not late data.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..frames import KEY, TIME
from ..operators import sparse
from ..operators.derivative import three_point
from ..operators.features import exponents
from ..operators.gram import Gram

#: What is left of a law is taken to be at least this share of the signal, so that a perfect fit does not make everything drift.
LEAST_SCALE = 1e-3

RECORD = f"{KEY} string, sequence long, kind string, window long, start_row long, stop_row long, start_t double, end_t double, sustained long, drift double, max_abs_z double, prior_revision string, revision string, laws string, diff string"


def least_rows(window: int, degree: int) -> int:
    """Rows that a fit needs: a few for each power, never more than the window."""
    return min(window, max(8, 4 * (degree + 1)))


def names(states: list[str], degree: int) -> list[str]:
    return ["*".join(s for s, k in zip(states, e, strict=True) for _ in range(k)) or "1" for e in exponents(len(states), degree)]


def design(x: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([np.prod(x ** np.array(e), axis=1) for e in exponents(x.shape[1], degree)], axis=1)


class Law:
    """Polynomial laws of some states: coefficients[state, term], and what they leave on the window where they were found."""

    def __init__(self, states: list[str], degree: int, coefficients: np.ndarray, scale: np.ndarray | None = None):
        self.states, self.degree, self.coefficients, self.scale = states, degree, coefficients, scale

    def slopes(self, x: np.ndarray) -> np.ndarray:
        return self.coefficients @ design(x[None], self.degree)[0]

    def terms(self) -> dict[str, dict[str, float]]:
        return {s: {n: float(c) for n, c in zip(names(self.states, self.degree), row, strict=True) if c} for s, row in zip(self.states, self.coefficients, strict=True)}

    def revision(self) -> str:
        """A digest of what the laws say, alike for like laws."""
        return hashlib.sha256(json.dumps(self.terms(), sort_keys=True).encode()).hexdigest()

    def residuals(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Observed less integrated from the first row, a step for each row; infinite where the law leaves the finite numbers."""
        out = [x[0]]
        with np.errstate(all="ignore"):
            for h in np.diff(t):
                a = self.slopes(out[-1])
                b = self.slopes(out[-1] + h / 2 * a)
                c = self.slopes(out[-1] + h / 2 * b)
                out.append(out[-1] + h / 6 * (a + 2 * b + 2 * c + self.slopes(out[-1] + h * c)))
        left = x - np.array(out)
        return np.where(np.isfinite(left), left, np.inf)


def find(t: np.ndarray, x: np.ndarray, states: list[str], degree: int, threshold: float) -> Law:
    d = np.stack([three_point(t, v) for v in x.T], axis=1)[1:-1]
    m = design(x[1:-1], degree)
    g = Gram(names(states, degree), len(m), m.T @ m, m.T @ d, (d * d).sum(axis=0), d.sum(axis=0))
    law = Law(states, degree, np.array([sparse.stlsq(g, k, threshold) for k in range(len(states))]))
    left = np.sqrt((law.residuals(t, x) ** 2).mean(axis=0))
    law.scale = np.maximum(left, LEAST_SCALE * np.maximum(1.0, np.sqrt((x * x).mean(axis=0))))
    return law


def difference(old: Law, new: Law) -> list[dict]:
    """Terms that come, go or change, by state and name."""
    a, b, out = old.terms(), new.terms(), []
    for s in sorted(set(a) | set(b)):
        for n in sorted(set(a.get(s, {})) | set(b.get(s, {}))):
            x, y = a.get(s, {}).get(n), b.get(s, {}).get(n)
            if x != y:
                out.append({"state": s, "term": n, "change": "added" if x is None else "removed" if y is None else "changed", "old": x, "new": y})
    return out


class Watch:
    """One series as its rows come in."""

    def __init__(self, states: list[str], window: int = 64, step: int | None = None, degree: int = 2, threshold: float = 0.05, limit: float = 3.0, sustain: int = 2, growing: bool = False, state: str | None = None):
        self.states, self.window, self.step = list(states), window, step or window
        self.degree, self.threshold, self.limit, self.sustain = degree, threshold, limit, sustain
        if window < least_rows(window, degree) or self.step < 1 or sustain < 1 or not limit > 0 or window < 8:
            raise ValueError("a window of 8 rows or more, a positive step, limit and number of windows that a drift lasts")
        first = max(self.step, least_rows(window, degree)) if growing else window
        self.s = json.loads(state) if state else {"t": [], "x": [], "begin": 0, "stop": min(first, window), "index": 0, "sequence": 0, "streak": 0, "law": None, "scale": None}

    def state(self) -> str:
        return json.dumps(self.s)

    def add(self, t: np.ndarray, x: np.ndarray) -> list[dict]:
        s, out = self.s, []
        if len(t) and (np.any(np.diff(t) <= 0) or (s["t"] and t[0] <= s["t"][-1])):
            raise ValueError("t must strictly increase")
        s["t"] += t.tolist()
        s["x"] += x.tolist()
        while s["begin"] + len(s["t"]) >= s["stop"]:
            start = max(0, s["stop"] - self.window)
            own = slice(start - s["begin"], s["stop"] - s["begin"])
            if record := self._window(np.array(s["t"][own]), np.array(s["x"][own], float), start):
                out.append(record)
            s["index"] += 1
            grown = s["stop"] < self.window  # a window that still grows ends at the full width next, at the latest
            s["stop"] = min(s["stop"] + self.step, self.window) if grown else s["stop"] + self.step
            drop = min(len(s["t"]) - 1, max(0, s["stop"] - self.window - s["begin"]))
            s["t"], s["x"], s["begin"] = s["t"][drop:], s["x"][drop:], s["begin"] + drop
        return out

    def _window(self, t: np.ndarray, x: np.ndarray, start: int) -> dict | None:
        s = self.s
        law = None if s["law"] is None else Law(self.states, self.degree, np.array(s["law"]), np.array(s["scale"]))
        drift, peak, kind = 0.0, 0.0, "initial"
        if law is not None:
            left = law.residuals(t, x)
            drift, kind = float((np.sqrt((left * left).mean(axis=0)) / law.scale).max()), "update"
            spread = np.median(np.abs(left - np.median(left, axis=0)), axis=0) if np.isfinite(left).all() else np.full(x.shape[1], np.nan)
            z = np.abs(left - np.median(left, axis=0)) / np.maximum(1.4826 * spread, 1e-9 * np.maximum(1.0, np.sqrt((x * x).mean(axis=0))))
            peak = float(z.max()) if np.isfinite(z).all() else float("inf")
            s["streak"] = s["streak"] + 1 if drift > self.limit else 0
            if s["streak"] < self.sustain:
                return None
        new = find(t, x, self.states, self.degree, self.threshold)
        record = {
            "sequence": s["sequence"], "kind": kind, "window": s["index"], "start_row": start, "stop_row": start + len(t), "start_t": float(t[0]), "end_t": float(t[-1]), "sustained": s["streak"], "drift": drift, "max_abs_z": peak,
            "prior_revision": law.revision() if law else None, "revision": new.revision(), "laws": json.dumps(new.terms(), sort_keys=True), "diff": json.dumps(difference(law, new) if law else []),
        }
        s["law"], s["scale"], s["streak"], s["sequence"] = new.coefficients.tolist(), new.scale.tolist(), 0, s["sequence"] + 1
        return record


def _frame(key, found: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{KEY: key, **r} for r in found], columns=[c.split()[0] for c in RECORD.split(", ")])


def history(df: DataFrame, states: list[str], **options) -> DataFrame:
    """Change records of a batch frame: the first law of each series, and each later one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        return _frame(g[KEY].iloc[0], Watch(states, **options).add(g[TIME].to_numpy(), g[list(states)].to_numpy(float)))

    return df.select(KEY, TIME, *states).groupBy(KEY).applyInPandas(run, RECORD)


def change_points(records: DataFrame) -> DataFrame:
    return records.where("kind = 'update'").select(KEY, "window", "start_t")


def watch(stream: DataFrame, states: list[str], **options) -> DataFrame:
    """The same records of a streaming frame; one state a series, taken up again from the query's checkpoint."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Watch(states, **options, state=state.get[0] if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(TIME)
        found = own.add(rows[TIME].to_numpy(), rows[list(states)].to_numpy(float))
        state.update((own.state(),))
        if found:
            yield _frame(key[0], found)

    return stream.select(KEY, TIME, *states).groupBy(KEY).applyInPandasWithState(run, RECORD, "state string", "append", "NoTimeout")

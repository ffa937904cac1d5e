"""Implicit laws, conserved quantities, parameter sweeps and sensitivities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours
from ..functions import expressions as ex
from ..operators.derivative import finite_difference
from ..operators.features import polynomial
from ..operators.gram import Gram, gram
from .discovery import World, rk4
from .linear import classify, fixed_points


def interior(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with central derivatives d_<c>: both ends of each series are left out."""
    d = neighbours(finite_difference(df.select(KEY, TIME, *columns), columns), [])
    return d.where(F.col(f"prev_{TIME}").isNotNull() & F.col(f"next_{TIME}").isNotNull())


def implicit_law(df: DataFrame, column: str, degree: int = 2, threshold: float = 0.02, rounds: int = 10) -> tuple[dict[str, float], dict[str, float]]:
    """x' = p(x) / q(x): the sparsest of the fits of each term of p(x) - q(x) x' = 0 on the others, all from one Gram.

    Returns the coefficients of p and of q, scaled so that the largest of q is 1.
    """
    base = polynomial([column], degree)
    terms = base + [(f"{n}@", c * F.col(f"d_{column}")) for n, c in base]
    m = gram(interior(df, [column]), terms, [("0", F.lit(0.0))])
    scale = np.sqrt(np.maximum(np.diag(m.g) / max(m.n, 1), 1e-300))
    g = m.g / np.outer(scale, scale)
    best = None
    for left in range(len(terms)):
        active = [i for i in range(len(terms)) if i != left]
        for _ in range(rounds):
            c = np.linalg.lstsq(g[np.ix_(active, active)], g[active, left], rcond=1e-12)[0]
            kept = [i for i, v in zip(active, c, strict=True) if abs(v) >= threshold]
            if len(kept) == len(active) or not kept:
                break
            active = kept
        if not active:
            continue
        v = np.zeros(len(terms))
        v[left], v[active] = -1.0, np.linalg.lstsq(g[np.ix_(active, active)], g[active, left], rcond=1e-12)[0]
        error = float(v @ g @ v) / max(g[left, left], 1e-300)
        k = len(base)
        if np.any(v[k:]) and np.any(v[:k]):
            key = (round(np.log10(max(error / m.n, 1e-12))), int((v != 0).sum()), error)
            if best is None or key < best[0]:
                best = (key, v / scale)
    if best is None:
        return {}, {}
    p, q = best[1][: len(base)], -best[1][len(base) :]
    by = q[np.abs(q).argmax()]
    names = [n for n, _ in base]
    return {n: float(c / by) for n, c in zip(names, p, strict=True) if c}, {n: float(c / by) for n, c in zip(names, q, strict=True) if c}


def invariants(df: DataFrame, world: World, degree: int = 2, tolerance: float = 1e-6) -> list[dict[str, float]]:
    """Combinations of monomials that stay constant along the law: the null space of the Gram of their Lie derivatives."""
    names = [n for n, _ in polynomial(world.states, degree) if n != "1"]
    lie = [(n, ex.to_column(ex.lie_derivative(ex.parse(n), world.laws))) for n in names]
    m = gram(df, lie, [("0", F.lit(0.0))])
    s = np.sqrt(np.maximum(np.diag(m.g), 1e-300))
    values, vectors = np.linalg.eigh(m.g / np.outer(s, s))
    out = []
    for value, v in zip(values, (vectors / s[:, None]).T, strict=True):
        if value <= tolerance:
            v = v / v[np.abs(v).argmax()]
            out.append({n: float(c) for n, c in zip(names, v, strict=True) if abs(c) > 1e-6})
    return out


def sweep(laws: dict[str, ex.Node], states: list[str], parameter: str, values: list[float], seeds: np.ndarray) -> list[tuple[float, list[float], str]]:
    """(value, fixed point, kind) along a parameter; points found before are the next value's first seeds."""
    out, last = [], np.empty((0, len(states)))
    for p in values:
        w = World(states, {s: ex.simplify(ex.substitute(e, {parameter: ex.num(p)})) for s, e in laws.items()}, {}, {})
        points = fixed_points(w.slopes, w.jacobian, np.concatenate([last, seeds]))
        out += [(p, x.tolist(), kind) for x, kind in points]
        last = np.array([x for x, _ in points]).reshape(-1, len(states))
    return out


def turns(branch: list[tuple[float, list[float], str]]) -> list[float]:
    """Values of a parameter where the number or the kinds of fixed points change."""
    by: dict[float, list[str]] = {}
    for p, _, kind in branch:
        by.setdefault(p, []).append(kind)
    keys = sorted(by)
    return [b for a, b in zip(keys, keys[1:], strict=False) if sorted(by[a]) != sorted(by[b])]


def sensitivities(world: World, parameters: dict[str, float], x0: np.ndarray, h: float, steps: int) -> np.ndarray:
    """steps + 1 x states x parameters: how the trajectory moves with each parameter, by the variational equations."""
    names, n = list(parameters), len(world.states)
    jx, jp = ({s: {v: ex.derivative(world.laws[s], v) for v in over} for s in world.states} for over in (world.states, names))

    def slopes(z: np.ndarray) -> np.ndarray:
        at = parameters | dict(zip(world.states, z[:n].tolist(), strict=True))
        s = z[n:].reshape(n, len(names))
        a = np.array([[ex.evaluate(jx[r][c], at) for c in world.states] for r in world.states])
        b = np.array([[ex.evaluate(jp[r][c], at) for c in names] for r in world.states])
        return np.concatenate([[ex.evaluate(world.laws[r], at) for r in world.states], (a @ s + b).ravel()])

    z = np.concatenate([x0, np.zeros(n * len(names))])
    out = [z]
    for _ in range(steps):
        z = rk4(slopes, z, h)
        out.append(z)
    return np.array(out)[:, n:].reshape(steps + 1, n, len(names))


def delta_forecast(s: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Standard deviations of each state along a trajectory: the square roots of the diagonals of S C S'."""
    return np.sqrt(np.einsum("tip,pq,tiq->ti", s, covariance, s))


def stability(world: World, point: np.ndarray) -> str:
    return classify(np.linalg.eigvals(world.jacobian(point)))


def covariance_of_fit(m: Gram, c: np.ndarray, target: int = 0) -> np.ndarray:
    """Covariance of the active coefficients under independent errors."""
    active = np.flatnonzero(c)
    out = np.zeros((len(c), len(c)))
    if len(active) and m.n > len(active):
        out[np.ix_(active, active)] = np.linalg.pinv(m.g[np.ix_(active, active)]) * m.rss(c, target) / (m.n - len(active))
    return out

"""Worlds as data: fingerprints, differences, composition, editing, symbolic candidates, refinement."""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators.gram import gram
from .discovery import World, trajectory


def fnv1a(text: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def to_json(world: World) -> str:
    return json.dumps({"states": world.states, "laws": {s: ex.to_text(world.laws[s]) for s in sorted(world.laws)}}, sort_keys=True)


def from_json(text: str) -> World:
    d = json.loads(text)
    return World(d["states"], {s: ex.parse(e) for s, e in d["laws"].items()}, {}, {})


def fingerprint(world: World) -> str:
    return f"{fnv1a(to_json(world)):016x}"


def difference(old: dict[str, dict[str, float]], new: dict[str, dict[str, float]]) -> list[tuple[str, str, str, float | None, float | None]]:
    """(state, term, added / removed / changed, before, after) over the terms of two sets of laws."""
    out = []
    for s in sorted({*old, *new}):
        a, b = ({t: c for t, c in d.get(s, {}).items() if c} for d in (old, new))
        for t in sorted({*a, *b}):
            if a.get(t) != b.get(t):
                out.append((s, t, "added" if t not in a else "removed" if t not in b else "changed", a.get(t), b.get(t)))
    return out


def compose(a: World, b: World) -> World:
    """Both worlds' laws; a state that both have must have the same law."""
    for s in set(a.laws) & set(b.laws):
        if ex.to_text(ex.simplify(a.laws[s])) != ex.to_text(ex.simplify(b.laws[s])):
            raise ValueError(f"two laws for {s}")
    return World([*a.states, *(s for s in b.states if s not in a.states)], a.laws | b.laws, a.coefficients | b.coefficients, a.scores | b.scores)


def bind(world: World, values: dict[str, float]) -> World:
    """Parameters replaced by constants."""
    put = {k: ex.num(v) for k, v in values.items()}
    return World(world.states, {s: ex.simplify(ex.substitute(e, put)) for s, e in world.laws.items()}, world.coefficients, world.scores)


def enumerate_expressions(variables: list[str], depth: int = 2, most: int = 256) -> list[ex.Node]:
    """Breadth first: sums, then products, of what is known, each canonical text once."""
    known = {ex.to_text(e): e for e in (("sym", v) for v in variables)}
    frontier = list(known.values())
    for _ in range(depth):
        new = []
        for op, a, b in itertools.product("+*", frontier, list(known.values())):
            x, y = sorted((a, b), key=ex.to_text)
            e = ex.simplify((op, x, y))
            if (t := ex.to_text(e)) not in known and len(known) < most:
                known[t] = e
                new.append(e)
        frontier = new
    return list(known.values())


def best_affine(df: DataFrame, target: str, candidates: list[ex.Node], chunk: int = 60) -> list[tuple[float, int, str, float, float]]:
    """(mse, size, expression, scale, offset) of each candidate fitted as scale * e + offset, best first; one aggregate a chunk."""
    out = []
    for at in range(0, len(candidates), chunk):
        part = candidates[at : at + chunk]
        m = gram(df, [("1", F.lit(1.0)), *((ex.to_text(e), ex.to_column(e)) for e in part)], [(target, F.col(target))])
        for i, e in enumerate(part, 1):
            c = m.solve([0, i], ridge=0.0)
            out.append((m.rss(c) / max(m.n, 1), ex.size(e), ex.to_text(e), float(c[i]), float(c[0])))
    return sorted(out, key=lambda r: (r[0], r[1], r[2]))


def coordinate_minimize(f, x: np.ndarray, step: float = 0.5, rounds: int = 200, least: float = 1e-8) -> np.ndarray:
    """Pattern search along the axes; only strict improvement is taken, the step halves where there is none."""
    x, best = np.array(x, float), f(np.array(x, float))
    for _ in range(rounds):
        moved = False
        for k, s in itertools.product(range(len(x)), (1, -1)):
            y = x.copy()
            y[k] += s * step
            if (v := f(y)) < best:
                x, best, moved = y, v, True
        if not moved:
            step /= 2
            if step < least:
                break
    return x


def nelder_mead(f, x: np.ndarray, step: float = 0.5, rounds: int = 400, tolerance: float = 1e-12, low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf) -> np.ndarray:
    """The downhill simplex; every point that is tried is moved into the box of low and high first."""
    if np.any(np.asarray(low) > np.asarray(high)):
        raise ValueError("a box whose low side lies above its high side")
    boxed = lambda p: np.clip(p, low, high)
    first = boxed(np.array(x, float))
    # An edge that would leave the box goes the other way, so that the simplex does not begin flat.
    points = [first, *(p if not np.array_equal(p := boxed(first + step * e), first) else boxed(first - step * e) for e in np.eye(len(x)))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        trial = lambda k: (p := boxed(centre + k * (points[-1] - centre)), f(p))
        p, v = trial(-1.0)
        if v < values[0]:
            q, w = trial(-2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            p, v = trial(0.5 if v >= values[-1] else -0.5)
            if v >= values[-1]:
                points = [points[0], *(points[0] + (q - points[0]) / 2 for q in points[1:])]
                values = [values[0], *map(f, points[1:])]
                continue
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


def lbfgs(f, slope, x: np.ndarray, memory: int = 8, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a backtracking line search; pairs without positive curvature are left out."""
    x, g = np.array(x, float), np.asarray(slope(x), float)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            kept.append(s @ d / (s @ y))
            d -= kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d += (a - y @ d / (s @ y)) * s
        if d @ g <= 0:
            d, pairs = g.copy(), []
        size, here = 1.0, f(x)
        while not f(x - size * d) <= here - 1e-4 * size * (d @ g):
            size /= 2
            if size < 1e-16:
                return x
        new = x - size * d
        after = np.asarray(slope(new), float)
        if (new - x) @ (after - g) > 1e-14:
            pairs = [*pairs, (new - x, after - g)][-memory:]
        x, g = new, after
    return x


def mutate_symbol(e: ex.Node, old: str, new: str) -> ex.Node:
    return ex.substitute(e, {old: ex.parse(new)})


def crossover_sum(a: ex.Node, b: ex.Node) -> ex.Node:
    return ("+", a, b)


def quadratic_profile(points: list[tuple[float, float]], rise: float = 1.920729410347062) -> tuple[float, float, float]:
    """(best, low, high) of a parameter from (value, loss): the parabola through them, and where it is rise above its least."""
    if len({v for v, _ in points}) < 3:
        raise ValueError("a parabola needs three values")
    a, b, _ = np.polyfit(*np.array(points).T, 2)
    if a <= 0:
        raise ValueError("the losses have no least value")
    half = float(np.sqrt(rise / a))
    return float(-b / (2 * a)), float(-b / (2 * a)) - half, float(-b / (2 * a)) + half


def basins(world: World, starts: np.ndarray, h: float, steps: int, tolerance: float = 1e-2) -> list[int]:
    """The attractor that each start ends in, numbered as found; -1 where it runs away."""
    ends, out = [], []
    for x in starts:
        try:
            e = trajectory(world, x, h, steps)[-1]
        except (ValueError, OverflowError):
            out.append(-1)
            continue
        k = next((i for i, y in enumerate(ends) if np.abs(e - y).max() < tolerance), None)
        if k is None:
            ends.append(e)
            k = len(ends) - 1
        out.append(k)
    return out

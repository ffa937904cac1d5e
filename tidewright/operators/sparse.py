"""Sparse regressions over a Gram: p x p algebra on the driver, whatever the number of rows."""

from __future__ import annotations

import numpy as np

from .gram import Gram


def stlsq(m: Gram, target: int = 0, threshold: float = 0.05, rounds: int = 20, ridge: float = 1e-10) -> np.ndarray:
    """Sequentially thresholded ridge least squares; an empty support is the zero law."""
    active = list(range(len(m.names)))
    for _ in range(rounds):
        c = m.solve(active, target, ridge)
        kept = [i for i in active if abs(c[i]) >= threshold]
        if kept == active:
            return c
        active = kept
        if not active:
            return np.zeros(len(m.names))
    return m.solve(active, target, ridge)


def stlsq_standardized(m: Gram, target: int = 0, **options) -> np.ndarray:
    """The threshold acts on coefficients of terms scaled to a root mean square of 1."""
    scaled, s = m.scaled()
    return stlsq(scaled, target, **options) / s


def sr3(m: Gram, target: int = 0, threshold: float = 0.05, rounds: int = 200, ridge: float = 1e-6, damping: np.ndarray | None = None) -> np.ndarray:
    """Relaxed regression with a hard threshold; damping divides positive coefficients before it. The relaxed variable is the answer."""
    penalty, every, w = max(ridge, 1e-6), list(range(len(m.names))), np.zeros(len(m.names))
    for _ in range(rounds):
        c = m.solve(every, target, ridge, penalty, w)
        if damping is not None:
            c = np.where(c > 0, c / damping, c)
        new = np.where(np.abs(c) >= threshold, c, 0.0)
        if np.abs(new - w).max(initial=0) <= 1e-12:
            return new
        w = new
    return w


def trapping(m: Gram, own: int, target: int = 0, weight: float = 1.0, **options) -> np.ndarray:
    """SR3 that damps positive feedback of the target's own term."""
    damping = np.ones(len(m.names))
    damping[own] += weight
    return sr3(m, target, damping=damping, **options)


def _descend(m: Gram, target: int, rounds: int, tolerance: float, rule) -> np.ndarray:
    c, gc = np.zeros(len(m.names)), np.zeros(len(m.names))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(c)):
            norm = m.g[j, j]
            if norm <= 0:
                continue
            new = rule(m.b[j, target] - gc[j] + norm * c[j], norm)
            step = new - c[j]
            if step:
                gc += m.g[:, j] * step
                c[j] = new
                most = max(most, abs(step))
        if most <= tolerance:
            break
    return c


def lasso(m: Gram, target: int = 0, weight: float = 0.05, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Least 0.5 RSS + weight |c|_1 by coordinate descent."""
    return _descend(m, target, rounds, tolerance, lambda r, n: np.sign(r) * max(abs(r) - weight, 0) / n)


def nnls(m: Gram, target: int = 0, ridge: float = 1e-10, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    return _descend(m, target, rounds, tolerance, lambda r, n: max(r / (n + ridge), 0.0))


def frols(m: Gram, target: int = 0, most_terms: int = 20, ridge: float = 1e-10) -> np.ndarray:
    """Forward selection by error-reduction ratio; orthogonalisation is a Cholesky update of the Gram."""
    p, yy = len(m.names), m.yy[target]
    chosen: list[int] = []
    g, b = m.g.copy(), m.b[:, target].copy()
    for _ in range(min(most_terms, p)):
        energy = np.diag(g).copy()
        ok = (energy > 1e-14) & ~np.isin(np.arange(p), chosen)
        ratio = np.where(ok, b * b / np.where(ok, energy * yy, 1), -1.0) if yy > 0 else np.full(p, -1.0)
        j = int(ratio.argmax())
        if ratio[j] < 1e-12:
            break
        chosen.append(j)
        row = g[j].copy()
        b = b - row * b[j] / energy[j]
        g = g - np.outer(row, row) / energy[j]
    return m.solve(sorted(chosen), target, ridge)


def ssr(m: Gram, target: int = 0, ridge: float = 1e-10) -> np.ndarray:
    """Backward elimination of the smallest coefficient; the support of least AIC, the sparser one on ties."""
    active, best, least = list(range(len(m.names))), None, np.inf
    while active:
        c = m.solve(active, target, ridge)
        aic = m.n * np.log(max(m.rss(c, target), 1e-300) / m.n) + 2 * len(active)
        if aic <= least:
            best, least = c, aic
        active.remove(min(active, key=lambda i: (abs(c[i]), i)))
    return best if best is not None else np.zeros(len(m.names))


def group_stlsq(m: Gram, groups: list[list[int]], target: int = 0, threshold: float = 0.1, rounds: int = 20, ridge: float = 1e-10) -> np.ndarray:
    """Groups whose coefficients' L2 norm is below the threshold go together."""
    if sorted(i for g in groups for i in g) != list(range(len(m.names))):
        raise ValueError("the groups must partition the terms")
    kept = list(groups)
    for _ in range(rounds):
        c = m.solve(sorted(i for g in kept for i in g), target, ridge)
        new = [g for g in kept if np.linalg.norm(c[g]) >= threshold]
        if len(new) == len(kept):
            return c
        kept = new
    return m.solve(sorted(i for g in kept for i in g), target, ridge)


#: stlsq thresholds coefficients of scaled terms, stlsq_unscaled those of the terms as they are.
SOLVERS = {"stlsq": stlsq_standardized, "stlsq_unscaled": stlsq, "sr3": sr3, "lasso": lasso, "nnls": nnls, "frols": frols, "ssr": ssr}


def selection_stability(supports: list[set[int]], terms: int) -> tuple[list[float], float]:
    """Frequency of each term over the replicates, and the mean Jaccard similarity of pairs of supports."""
    frequency = [sum(k in s for s in supports) / max(len(supports), 1) for k in range(terms)]
    pairs = [(a, b) for i, a in enumerate(supports) for b in supports[i + 1 :]]
    return frequency, float(np.mean([len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs])) if pairs else 1.0

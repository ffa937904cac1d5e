"""Linear models and control of small systems: dense algebra of a few states, on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours
from ..operators.features import polynomial
from ..operators.gram import gram


def _successive(df: DataFrame, now: list[str], then: list[str]) -> DataFrame:
    """Columns now, and as n_<c> those of the next row of the series, without rows that lack one."""
    pairs = neighbours(df.select(KEY, TIME, *now), then)
    return pairs.select(*now, *[F.col(f"next_{c}").alias(f"n_{c}") for c in then]).dropna()


def dmd(df: DataFrame, columns: list[str], controls: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A (and B, with controls) of x' = A x + B u from successive rows, by the Gram of one pass."""
    rows = _successive(df, [*columns, *controls], columns)
    m = gram(rows, [(c, F.col(c)) for c in [*columns, *controls]], [(c, F.col(f"n_{c}")) for c in columns])
    k = np.linalg.lstsq(m.g, m.b, rcond=None)[0].T
    return k[:, : len(columns)], k[:, len(columns) :]


def edmd(df: DataFrame, columns: list[str], degree: int) -> tuple[list[str], np.ndarray]:
    """The Koopman matrix on monomials up to degree."""
    rows = _successive(df, columns, columns)
    names, now = zip(*polynomial(columns, degree), strict=True)
    lifted = rows.select(*[c.alias(f"f{i}") for i, c in enumerate(now)], *[c.alias(f"g{i}") for i, (_, c) in enumerate(polynomial([f"n_{c}" for c in columns], degree))])
    m = gram(lifted, [(n, F.col(f"f{i}")) for i, n in enumerate(names)], [(n, F.col(f"g{i}")) for i, n in enumerate(names)])
    return list(names), np.linalg.lstsq(m.g, m.b, rcond=None)[0].T


def classify(eigenvalues: np.ndarray, tolerance: float = 1e-9) -> str:
    re, im = eigenvalues.real, np.abs(eigenvalues.imag) > tolerance
    if np.any(np.abs(re) <= tolerance):
        return "center" if im.all() and np.all(np.abs(re) <= tolerance) else "non-hyperbolic"
    if np.all(re < 0):
        return "stable focus" if im.any() else "stable node"
    if np.all(re > 0):
        return "unstable focus" if im.any() else "unstable node"
    return "saddle"


def fixed_points(slopes, jacobian, seeds: np.ndarray, rounds: int = 60, tolerance: float = 1e-10) -> list[tuple[np.ndarray, str]]:
    """Newton from each seed; distinct points with the kind of their eigenvalues."""
    out: list[tuple[np.ndarray, str]] = []
    for x in seeds:
        x = np.array(x, float)
        for _ in range(rounds):
            f = slopes(x)
            if np.abs(f).max() <= tolerance:
                if not any(np.abs(x - y).max() < 1e-6 for y, _ in out):
                    out.append((x, classify(np.linalg.eigvals(jacobian(x)))))
                break
            try:
                x = x - np.linalg.solve(jacobian(x), f)
            except np.linalg.LinAlgError:
                break
            if not np.all(np.isfinite(x)) or np.abs(x).max() > 1e12:
                break
    return out


def lyapunov_exponents(slopes, jacobian, x: np.ndarray, h: float, steps: int) -> np.ndarray:
    """Benettin: tangent vectors carried along by the Jacobian, made orthonormal at every step."""
    x, q, total = np.array(x, float), np.eye(len(x)), np.zeros(len(x))
    for _ in range(steps):
        k1 = jacobian(x)
        a = slopes(x)
        mid = x + h / 2 * a
        b = slopes(mid)
        q = q + h * (jacobian(mid) @ (q + h / 2 * k1 @ q))
        x = x + h * b
        q, r = np.linalg.qr(q)
        total += np.log(np.abs(np.diag(r)))
        q = q * np.sign(np.diag(r))
    return total / (steps * h)


def lyapunov_equation(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X of A X + X A' + Q = 0."""
    n, i = len(a), np.eye(len(a))
    return np.linalg.solve(np.kron(i, a) + np.kron(a, i), -q.flatten(order="F")).reshape(n, n, order="F")


def lqr(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The gain from the stable subspace of the Hamiltonian, refined by Kleinman's iteration."""
    n = len(a)
    h = np.block([[a, -b @ np.linalg.solve(r, b.T)], [-q, -a.T]])
    values, vectors = np.linalg.eig(h)
    v = vectors[:, values.real < 0]
    if v.shape[1] != n:
        raise ValueError("no stabilising gain")
    k = np.linalg.solve(r, b.T @ (v[n:] @ np.linalg.inv(v[:n])).real)
    for _ in range(rounds):
        p = lyapunov_equation((a - b @ k).T, q + k.T @ r @ k)
        new = np.linalg.solve(r, b.T @ p)
        if np.abs(new - k).max() < 1e-12:
            return new
        k = new
    return k


def dare(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    p = q.copy()
    for _ in range(rounds):
        new = q + a.T @ p @ a - a.T @ p @ b @ np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)
        if np.abs(new - p).max() < 1e-13 * max(1.0, np.abs(new).max()):
            return new
        p = new
    return p


def dlqr(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    p = dare(a, b, q, r)
    return np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)


def kalman_gain(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return lqr(a.T, c.T, q, r).T


def controllability(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hstack([np.linalg.matrix_power(a, k) @ b for k in range(len(a))])


def observability(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return controllability(a.T, c.T).T


def controllability_gramian(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lyapunov_equation(a, b @ b.T)


def observability_gramian(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return lyapunov_equation(a.T, c.T @ c)


def observer_gain(a: np.ndarray, c: np.ndarray, poles: list[complex]) -> np.ndarray:
    """L such that a - L c has the poles; for discrete systems alike."""
    return place_poles(a.T, c.T, poles).T


def mpc_gain(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, horizon: int) -> np.ndarray:
    """The first input's gain of a horizon without bounds, by the backward recursion from the last step's weight q."""
    p, k = q, np.zeros((b.shape[1], len(a)))
    for _ in range(horizon):
        k = np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)
        p = q + a.T @ p @ (a - b @ k)
    return k


def bounded_mpc(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, x: np.ndarray, horizon: int, low: float, high: float, rounds: int = 500) -> np.ndarray:
    """The horizon's inputs within bounds, by projected gradient steps on the condensed cost."""
    n, m = b.shape
    free = np.vstack([np.linalg.matrix_power(a, k + 1) for k in range(horizon)])
    forced = np.zeros((n * horizon, m * horizon))
    for i in range(horizon):
        for j in range(i + 1):
            forced[i * n : (i + 1) * n, j * m : (j + 1) * m] = np.linalg.matrix_power(a, i - j) @ b
    weight = np.kron(np.eye(horizon), q)
    h, g = forced.T @ weight @ forced + np.kron(np.eye(horizon), r), forced.T @ weight @ free @ x
    u, step = np.zeros(m * horizon), 1 / np.linalg.eigvalsh(h).max()
    for _ in range(rounds):
        new = np.clip(u - step * (h @ u + g), low, high)
        if np.abs(new - u).max() < 1e-13:
            break
        u = new
    return u.reshape(horizon, m)


def modes(operator: np.ndarray, dt: float = 1.0) -> list[tuple[complex, complex]]:
    """Eigenvalues of a discrete operator, largest first, and the rates of growth and frequencies that they stand for."""
    values = sorted(np.linalg.eigvals(operator).tolist(), key=lambda z: (-abs(z), -complex(z).real, -complex(z).imag))
    return [(complex(z), complex(np.log(complex(z)) / dt) if z else complex(-np.inf)) for z in values]


def place_poles(a: np.ndarray, b: np.ndarray, poles: list[complex]) -> np.ndarray:
    """Ackermann's gain, for one input."""
    m = np.zeros_like(a, dtype=complex)
    for k, c in enumerate(np.poly(poles)[::-1]):
        m = m + c * np.linalg.matrix_power(a, k)
    e = np.zeros((1, len(a)))
    e[0, -1] = 1
    return (e @ np.linalg.inv(controllability(a, b)) @ m).real


def hankel_values(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    w, m = lyapunov_equation(a, b @ b.T), lyapunov_equation(a.T, c.T @ c)
    return np.sort(np.sqrt(np.abs(np.linalg.eigvals(w @ m).real)))[::-1]


def balanced_truncation(a: np.ndarray, b: np.ndarray, c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, m = lyapunov_equation(a, b @ b.T), lyapunov_equation(a.T, c.T @ c)
    root = np.linalg.cholesky(w + 1e-14 * np.eye(len(a)))
    u, s, _ = np.linalg.svd(root.T @ m @ root)
    t = root @ u / s**0.25
    i = np.linalg.inv(t)
    return (i @ a @ t)[:order, :order], (i @ b)[:order], (c @ t)[:, :order]

"""Derivatives of series, as window expressions where the rule is local, per series where it is not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..frames import KEY, TIME, neighbours, quotient, within_rows


def finite_difference(df: DataFrame, columns: list[str], strict: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """d_<c>: three-point differences on an irregular grid, one-sided at the ends.

    Rows at one instant are an error of Spark's division by zero; with strict=False they stay, in the order of ties, and have the quotients
    of SQL: infinite or NaN.
    """
    b, over = neighbours(df, columns, ties=ties), (lambda x, y: x / y) if strict else quotient
    left, right = F.col(TIME) - F.col(f"prev_{TIME}"), F.col(f"next_{TIME}") - F.col(TIME)
    out = {}
    for c in columns:
        v, p, n = F.col(c), F.col(f"prev_{c}"), F.col(f"next_{c}")
        inner = over(-right * p, left * (left + right)) + over((right - left) * v, left * right) + over(left * n, right * (left + right))
        out[f"d_{c}"] = F.when(left.isNull(), over(n - v, right)).when(right.isNull(), over(v - p, left)).otherwise(inner)
    return b.withColumns(out).select(*df.columns, *out)


def savitzky_golay(df: DataFrame, column: str, window: int = 5) -> DataFrame:
    """d_<column>: slope of a local quadratic over window rows; at the ends the window is shifted, not cut."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 3")
    return within_rows(df, window - 1, window - 1, lambda rows, w: _savitzky_golay(rows, column, window, w))


def _savitzky_golay(df: DataFrame, column: str, window: int, w: WindowSpec) -> DataFrame:
    r = window // 2
    rows = F.collect_list(F.struct(F.col(TIME).alias("t"), F.col(column).alias("v"))).over(w.rowsBetween(1 - window, window - 1))
    before, after = F.count("*").over(w.rowsBetween(1 - window, -1)), F.count("*").over(w.rowsBetween(1, window - 1))
    b = df.withColumn("rows_", rows).withColumn("before_", before).withColumn("after_", after)
    # start within the collected rows: r before the row, moved so that the window fits.
    start = F.greatest(F.lit(0), F.least(F.col("before_") - r, F.col("before_") + F.col("after_") + 1 - window))
    part = F.slice("rows_", (start + 1).cast("int"), window)
    moment = lambda k, value: F.aggregate("part_", F.lit(0.0), lambda s, p: s + (F.pow(p["t"] - F.col(TIME), k) if k else F.lit(1.0)) * (p["v"] if value else 1))
    b = b.withColumn("part_", part).withColumns({f"s{k}_": moment(k, False) for k in range(5)} | {f"b{k}_": moment(k, True) for k in range(3)})
    s0, s1, s2, s3, s4 = (F.col(f"s{k}_") for k in range(5))
    b0, b1, b2 = (F.col(f"b{k}_") for k in range(3))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    slope = (s0 * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2)) / det
    return b.withColumn(f"d_{column}", slope).select(*df.columns, f"d_{column}")


def _per_series(df: DataFrame, column: str, rule) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        return g.assign(**{f"d_{column}": rule(g[TIME].to_numpy(), g[column].to_numpy())})

    rows = df.select(KEY, TIME, column)
    return rows.groupBy(KEY).applyInPandas(run, rows.withColumn(f"d_{column}", F.lit(0.0)).schema)


def spline_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the natural cubic spline."""
    n = len(t)
    if n < 3:
        return np.full(n, (v[-1] - v[0]) / (t[-1] - t[0])) if n > 1 else np.zeros(n)
    h, s = np.diff(t), np.diff(v) / np.diff(t)
    low, mid, up, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    low[1:-1], up[1:-1], mid[1:-1], rhs[1:-1] = h[:-1], h[1:], 2 * (h[:-1] + h[1:]), 6 * np.diff(s)
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.zeros(n)
    for i in range(n - 1, -1, -1):
        m[i] = (rhs[i] - (up[i] * m[i + 1] if i + 1 < n else 0)) / mid[i]
    out = np.empty(n)
    out[:-1] = s - h * (2 * m[:-1] + m[1:]) / 6
    out[-1] = s[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
    return out


def spectral_slopes(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = np.diff(t)
    if len(t) < 2 or np.any(np.abs(h - h[0]) > 1e-10 * max(1.0, abs(h[0]))):
        raise ValueError("a spectral derivative needs a regular grid")
    return np.fft.ifft(2j * np.pi * np.fft.fftfreq(len(v), h[0]) * np.fft.fft(v)).real


def tv_denoise(v: np.ndarray, weight: float, rounds: int = 5000, tolerance: float = 1e-9) -> np.ndarray:
    """Least 0.5 |x - v|^2 + weight |Dx|_1 by alternating directions (rho 1); the linear system is tridiagonal."""
    n = len(v)
    if n < 2 or weight == 0:
        return v.copy()
    d = np.diff(np.eye(n), axis=0) if n <= 400 else None
    inverse = np.linalg.inv(np.eye(n) + d.T @ d) if d is not None else None
    mid = np.full(n, 3.0)
    mid[[0, -1]] = 2.0

    def solve(b: np.ndarray) -> np.ndarray:
        if inverse is not None:
            return inverse @ b
        c, x = np.empty(n), b.copy()
        c[0] = -1 / mid[0]
        x[0] /= mid[0]
        for i in range(1, n):
            f = mid[i] + c[i - 1]
            c[i] = -1 / f
            x[i] = (x[i] + x[i - 1]) / f
        for i in range(n - 2, -1, -1):
            x[i] -= c[i] * x[i + 1]
        return x

    z, u = np.zeros(n - 1), np.zeros(n - 1)
    x = v.copy()
    for _ in range(rounds):
        q = z - u
        x = solve(v + np.concatenate([[-q[0]], q[:-1] - q[1:], [q[-1]]]))
        dx, old = np.diff(x), z
        z = np.sign(dx + u) * np.maximum(np.abs(dx + u) - weight, 0)
        u = u + dx - z
        if max(np.abs(dx - z).max(), np.abs(z - old).max()) <= tolerance:
            break
    return x


def three_point(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty(len(v))
    l, r = t[1:-1] - t[:-2], t[2:] - t[1:-1]
    out[1:-1] = -r * v[:-2] / (l * (l + r)) + (r - l) * v[1:-1] / (l * r) + l * v[2:] / (r * (l + r))
    out[0], out[-1] = (v[1] - v[0]) / (t[1] - t[0]), (v[-1] - v[-2]) / (t[-1] - t[-2])
    return out


def spline(df: DataFrame, column: str) -> DataFrame:
    return _per_series(df, column, spline_slopes)


def spectral(df: DataFrame, column: str) -> DataFrame:
    return _per_series(df, column, spectral_slopes)


def total_variation(df: DataFrame, column: str, weight: float = 0.1) -> DataFrame:
    return _per_series(df, column, lambda t, v: three_point(t, tv_denoise(v, weight)))

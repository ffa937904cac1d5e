"""Laws of fields and weak forms: stencils as windows, integrals as aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours
from ..operators import sparse
from ..operators.features import Term, polynomial
from ..operators.gram import Gram, gram


def stencils(field: DataFrame, dt: float, dx: float, order: int = 2) -> DataFrame:
    """field(t_idx, x_idx, u) -> with u_t and u_1 .. u_order, interior points only. Windows run within a time or a place."""
    along, across = Window.partitionBy("t_idx").orderBy("x_idx"), Window.partitionBy("x_idx").orderBy("t_idx")
    near = {k: (F.lag("u", -k).over(along) if k < 0 else F.lead("u", k).over(along)) for k in (-2, -1, 1, 2)}
    out = field.withColumn("u_t", (F.lead("u").over(across) - F.lag("u").over(across)) / (2 * dt))
    rules = [(near[1] - near[-1]) / (2 * dx), (near[1] - 2 * F.col("u") + near[-1]) / dx**2, (near[2] - 2 * near[1] + 2 * near[-1] - near[-2]) / (2 * dx**3)]
    out = out.withColumns({f"u_{k + 1}": rules[k] for k in range(order)})
    return out.dropna()


def field_terms(degree: int, order: int) -> list[Term]:
    """u^p and u^p * u_m."""
    out = []
    for m in range(order + 1):
        for p in range(degree + 1):
            name = "*".join(["u"] * p + ([f"u_{m}"] if m else [])) or "1"
            column = F.lit(1.0)
            for _ in range(p):
                column = column * F.col("u")
            out.append((name, column * F.col(f"u_{m}") if m else column))
    return out


def discover_field(field: DataFrame, dt: float, dx: float, degree: int = 1, order: int = 2, threshold: float = 0.05) -> dict[str, float]:
    """Sparse u_t over field_terms, both sides in units of the root mean square of u_t."""
    s = stencils(field, dt, dx, order)
    m = gram(s, field_terms(degree, order), [("u_t", F.col("u_t"))])
    c = sparse.stlsq_standardized(_in_units(m), threshold=threshold)
    return {n: float(v) for n, v in zip(m.names, c, strict=True) if v}


def _in_units(m: Gram) -> Gram:
    k = max(m.yy[0] / max(m.n, 1), 1e-300)
    return Gram(m.names, m.n, m.g / k, m.b / k, m.yy / k, m.y / k**0.5)


def weak_discover(df: DataFrame, column: str, degree: int = 2, tests: int = 20, width: float = 0.25, threshold: float = 0.05) -> dict[str, float]:
    """Sparse law without derivatives of the data: bumps phi give -int x phi' = sum c int f phi, by the trapezoid rule.

    Every row goes to the bumps over it; their integrals are one aggregate.
    """
    variables, terms = [column], polynomial([column], degree)
    steps = neighbours(df.select(KEY, TIME, *variables), [])
    r = df.groupBy(KEY).agg(F.min(TIME).alias("a_"), F.max(TIME).alias("b_"))
    weight = (F.coalesce(F.col(f"next_{TIME}"), F.col(TIME)) - F.coalesce(F.col(f"prev_{TIME}"), F.col(TIME))) / 2
    half = (F.col("b_") - F.col("a_")) * width / 2
    centre = F.col("a_") + half + (F.col("b_") - F.col("a_") - 2 * half) * F.col("k_") / max(tests - 1, 1)
    e = steps.join(r, KEY).withColumn("k_", F.explode(F.sequence(F.lit(0), F.lit(tests - 1)))).withColumn("s_", (F.col(TIME) - centre) / half).where("abs(s_) < 1")
    phi, slope = F.pow(1 - F.col("s_") * F.col("s_"), 4), -8 * F.col("s_") * F.pow(1 - F.col("s_") * F.col("s_"), 3) / half
    integrals = e.groupBy(KEY, "k_").agg(*[F.sum(weight * phi * c).alias(f"i{i}") for i, (_, c) in enumerate(terms)], F.sum(-weight * slope * F.col(column)).alias("y_"))
    m = gram(integrals, [(n, F.col(f"i{i}")) for i, (n, _) in enumerate(terms)], [("y", F.col("y_"))])
    return {n: float(v) for n, v in zip(m.names, sparse.stlsq(m, threshold=threshold), strict=True) if v}


def downsample(t: np.ndarray, v: np.ndarray, keep: int) -> np.ndarray:
    """Largest-triangle-three-buckets: places of keep points, both ends among them."""
    n = len(t)
    if keep >= n or keep < 3:
        return np.arange(n)
    borders, out = np.linspace(1, n - 1, keep - 1).astype(int), [0]
    for a, b, c in zip(borders[:-1], borders[1:], [*borders[2:], n], strict=True):
        mt, mv = t[b:c].mean() if b < c else t[-1], v[b:c].mean() if b < c else v[-1]
        p = out[-1]
        area = np.abs((t[p] - mt) * (v[a:b] - v[p]) - (t[p] - t[a:b]) * (mv - v[p]))
        out.append(a + int(area.argmax()))
    return np.array([*out, n - 1])


def decimate(df: DataFrame, column: str, keep: int) -> DataFrame:
    """Each series cut to keep telling points."""

    def run(g):
        g = g.sort_values(TIME)
        return g.iloc[downsample(g[TIME].to_numpy(), g[column].to_numpy(), keep)]

    rows = df.select(KEY, TIME, column)
    return rows.groupBy(KEY).applyInPandas(run, rows.schema)

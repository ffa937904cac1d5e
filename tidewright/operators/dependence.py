"""Dependence among columns: correlations, lags, information, Granger tests, transitions."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours, quotient, within_rows
from .features import Term
from .gram import gram


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson, cov_pop) of all unordered pairs, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    agg = df.agg(*[F.struct(F.corr(a, b).alias("pearson"), F.covar_pop(a, b).alias("cov_pop")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}.pearson").alias("pearson"), F.col(f"p{k}.cov_pop").alias("cov_pop")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def lag_correlations(df: DataFrame, left: str, right: str, most: int) -> DataFrame:
    """(series_id, lag, n, pearson) for lags from -most to most: left now with right lag rows later."""
    # Each row makes one row a lag, so all lags come from one window and one aggregate.
    shifted = within_rows(df.select(KEY, TIME, F.col(left).alias("l_"), F.col(right).alias("v_")), most, most, lambda rows, w: rows.withColumns({f"r{k + most}_": F.lead("v_", k).over(w) for k in range(-most, most + 1)}))
    p = shifted.select(KEY, "l_", F.posexplode(F.array(*[f"r{k}_" for k in range(2 * most + 1)])).alias("k_", "r_")).select(KEY, (F.col("k_") - most).alias("lag"), "l_", "r_").dropna()
    return p.groupBy(KEY, "lag").agg(F.count("*").alias("n"), F.corr("l_", "r_").alias("pearson"))


def best_lag(df: DataFrame, left: str, right: str, most: int) -> DataFrame:
    """The lag of the largest absolute correlation; ties go to the smaller absolute lag, then the smaller lag."""
    c = lag_correlations(df, left, right, most)
    order = F.struct(F.round(-F.abs("pearson"), 9), F.abs("lag"), F.col("lag"))
    return c.groupBy(KEY).agg(F.min_by(F.struct("lag", "pearson"), order).alias("b")).select(KEY, "b.*")


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 16) -> DataFrame:
    """Of equal-width bins, in nats, the last bin closed."""
    r = df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1))
    joint = df.crossJoin(F.broadcast(r)).groupBy(place(a).alias("i"), place(b).alias("j")).agg(F.count("*").alias("c"))  # r is one row; joint has bins ** 2
    all_ = Window.partitionBy(F.lit(1))
    p = joint.select("i", "j", (F.col("c") / F.sum("c").over(all_)).alias("p"), (F.sum("c").over(Window.partitionBy("i")) / F.sum("c").over(all_)).alias("pi"), (F.sum("c").over(Window.partitionBy("j")) / F.sum("c").over(all_)).alias("pj"))
    return p.agg(F.count("*").alias("cells"), F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pi") * F.col("pj")))).alias("mi"))


def granger(df: DataFrame, cause: str, effect: str, lag: int = 1) -> dict[str, float]:
    """F of lagged effect alone against lagged effect and cause; from the Gram of one window pass."""
    add = lambda rows, w: rows.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in (effect, cause) for k in range(1, lag + 1)})
    rows = within_rows(df.select(KEY, TIME, effect, cause), lag, 0, add).withColumn("y_", F.col(effect)).drop(KEY, TIME, effect, cause).dropna()
    terms: list[Term] = [("1", F.lit(1.0)), *((f"{c}_{k}", F.col(f"{c}_{k}")) for c in (effect, cause) for k in range(1, lag + 1))]
    m = gram(rows, terms, [("y", F.col("y_"))])
    if m.n < 12:
        raise ValueError("a Granger test needs 12 rows")
    small, every = list(range(1 + lag)), list(range(1 + 2 * lag))
    rss_r, rss_u = (m.rss(m.solve(a, ridge=0.0)) for a in (small, every))
    f = max(rss_r - rss_u, 0) / lag / (max(rss_u, 1e-12) / (m.n - len(every)))
    return {"n": m.n, "rss_restricted": rss_r, "rss_unrestricted": rss_u, "f": f}


def dependency_graph(df: DataFrame, columns: list[str], gate: float = 0.05, least_f: float = 4.0) -> list[tuple[str, str, float]]:
    """Edges cause -> effect that pass a correlation gate and a Granger test; those that would close a cycle are left out."""
    c = {(r["a"], r["b"]): r["pearson"] for r in correlation_pairs(df, columns).collect()}
    edges: list[tuple[str, str, float]] = []

    def reaches(a: str, b: str) -> bool:
        return a == b or any(reaches(y, b) for x, y, _ in edges if x == a)

    for a in sorted(columns):
        for b in sorted(columns):
            r = c.get((a, b), c.get((b, a)))
            if a != b and r is not None and abs(r) > gate and (f := granger(df, a, b)["f"]) >= least_f and not reaches(b, a):
                edges.append((a, b, f))
    return edges


def transitions(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """(from_state, to_state, n, p): consecutive states within keys."""
    nxt = F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))
    n = df.select(F.col(state).alias("from_state"), nxt.alias("to_state")).dropna().groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))  # states squared rows


def kramers_moyal(df: DataFrame, column: str, bins: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, bin, centre, n, drift, diffusion) of increments by the bin of where they begin.

    As in its SQL, steps between rows at one instant (in the order of ties) count, with infinite or NaN rates; a series of one value is all in the last bin.
    """
    r = df.groupBy(KEY).agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    steps = neighbours(df.select(KEY, TIME, column, *ties), [column], ties=ties).where(F.col(f"next_{TIME}").isNotNull())
    dt, dx = F.col(f"next_{TIME}") - F.col(TIME), F.col(f"next_{column}") - F.col(column)
    place = F.floor(F.least(quotient(F.col(column) - F.col("lo_"), (F.col("hi_") - F.col("lo_")) / bins), F.lit(bins - 1.0)))
    return steps.join(r, KEY).groupBy(KEY, place.alias("bin")).agg(F.avg(column).alias("centre"), F.count("*").alias("n"), F.avg(quotient(dx, dt)).alias("drift"), F.avg(quotient(dx * dx, dt)).alias("diffusion"))


def covariance_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Unbiased, from one aggregate."""
    row = df.agg(*[F.covar_samp(a, b) for a in columns for b in columns]).first()
    return np.array([float(v) for v in row]).reshape(len(columns), -1)



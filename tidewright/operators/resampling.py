"""Bootstrap replicates as weighted Gram sums: one aggregate by replicate, no row leaves the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import numbered
from . import sparse
from .features import Term
from .gram import Gram


def split_mix(seed: int, n: int) -> list[int]:
    """SplitMix64: n unsigned 64-bit values."""
    mask, out, s = (1 << 64) - 1, [], seed
    for _ in range(n):
        s = s + 0x9E3779B97F4A7C15 & mask
        z = (s ^ s >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return out


def without_replacement(population: int, count: int, seed: int) -> list[int]:
    """count distinct numbers below population, by the first steps of a seeded shuffle; memory goes with count, not with population."""
    if count > population:
        raise ValueError("a sample is no larger than its population")
    moved: dict[int, int] = {}
    out = []
    for k, r in enumerate(split_mix(seed, count)):
        at = k + r % (population - k)
        out.append(moved.get(at, at))
        moved[at] = moved.get(k, k)
    return out


def block_indices(n: int, block: int, seed: int) -> np.ndarray:
    """Circular moving blocks: starts modulo n, rows wrap around, n rows in all."""
    starts = [v % n for v in split_mix(seed, -(-n // block))]
    return np.concatenate([(s + np.arange(block)) % n for s in starts])[:n]


def replicate_weights(spark, n: int, replicates: int, block: int = 8, seed: int = 0) -> DataFrame:
    """(replicate, row, weight): how often each replicate takes each row; made on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["id"].tolist():
                rows, counts = np.unique(block_indices(n, block, split_mix(seed, r + 1)[-1]), return_counts=True)
                yield pd.DataFrame({"replicate": r, "row": rows, "weight": counts.astype(float)})

    return spark.range(replicates).mapInPandas(run, "replicate long, row long, weight double")


def replicate_grams(df: DataFrame, terms: list[Term], target: Term, replicates: int, block: int = 8, seed: int = 0) -> list[Gram]:
    """The Gram of each block-bootstrap replicate of one series."""
    rows = numbered(df).select(F.col("rn_").alias("row"), *[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(terms)], target[1].cast("double").alias("y0"))
    n, p = rows.count(), len(terms)
    w = rows.join(replicate_weights(df.sparkSession, n, replicates, block, seed), "row")
    names = [f"x{i}" for i in range(p)] + ["y0"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = w.groupBy("replicate").agg(F.sum("weight"), F.sum(F.col("weight") * F.col("y0")), *[F.sum(F.col("weight") * F.col(a) * F.col(b)) for a, b in pairs]).orderBy("replicate").collect()
    out = []
    for r in sums:
        full = np.zeros((p + 1, p + 1))
        full[np.triu_indices(p + 1)] = r[3:]
        full = full + np.triu(full, 1).T
        out.append(Gram([t for t, _ in terms], int(r[1]), full[:p, :p], full[:p, p:], full[p:, p].copy(), np.array([r[2]])))
    return out


def stability_selection(grams: list[Gram], **options) -> tuple[list[float], float]:
    """How often each term is selected over the replicates, and the mean Jaccard similarity of the selections."""
    return sparse.selection_stability([set(np.flatnonzero(sparse.stlsq(m, **options)).tolist()) for m in grams], len(grams[0].names) if grams else 0)


def coefficient_bootstrap(grams: list[Gram], low: float = 0.025, high: float = 0.975, **options) -> list[dict]:
    """Mean, deviation, interval and inclusion of each coefficient over the replicates."""
    c = np.array([sparse.stlsq(m, **options) for m in grams])
    return [{"term": n, "mean": float(v.mean()), "se": float(v.std(ddof=1)) if len(v) > 1 else 0.0, "low": float(np.quantile(v, low)), "high": float(np.quantile(v, high)), "inclusion": float((v != 0).mean())} for n, v in zip(grams[0].names, c.T, strict=True)]


def monte_carlo(model, mean: np.ndarray, covariance: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    return np.array([model(p) for p in np.random.default_rng(seed).multivariate_normal(mean, covariance, draws)])


def delta_band(gradient: np.ndarray, covariance: np.ndarray) -> float:
    return float(np.sqrt(gradient @ covariance @ gradient))


def structural_score(scores: list[float]) -> float:
    """1 less the sum of squared Akaike weights."""
    w = np.exp(-0.5 * (np.array(scores) - min(scores)))
    return float(1 - ((w / w.sum()) ** 2).sum())


def e_value(risk_ratio: float) -> float:
    r = 1 / risk_ratio if risk_ratio < 1 else risk_ratio
    return r + (r * (r - 1)) ** 0.5

"""Regimes: change points, segmentations, hidden states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, running_sum


def binary_split(df: DataFrame, column: str, least: int = 3) -> DataFrame:
    """(series_id, split_at, gain): the split of most reduction of squared error, the first on ties; from prefix sums."""
    mean = df.groupBy(KEY).agg(F.avg(column).alias("m_"), F.count("*").alias("n_"))
    c = df.join(mean, KEY).withColumn("v_", F.col(column) - F.col("m_"))
    total = c.groupBy(KEY).agg(F.sum("v_").alias("t_"), F.sum(F.col("v_") * F.col("v_")).alias("q_"))
    p = running_sum(c, "v_", "s_").select(KEY, "n_", F.col("rn_").alias("k_"), "s_")
    p = p.join(total, KEY).where((F.col("k_") >= least) & (F.col("n_") - F.col("k_") >= least))
    gain = F.col("s_") * F.col("s_") / F.col("k_") + F.pow(F.col("t_") - F.col("s_"), 2) / (F.col("n_") - F.col("k_")) - F.col("t_") * F.col("t_") / F.col("n_")
    return p.select(KEY, "k_", gain.alias("gain")).groupBy(KEY).agg(F.max_by(F.struct(F.col("k_").alias("split_at"), F.col("gain")), F.struct(F.round("gain", 9), -F.col("k_"))).alias("b")).select(KEY, "b.*")


def pelt_ends(v: np.ndarray, penalty: float = 8.0, least: int = 3) -> list[int]:
    """Ends of the segments of least penalised squared error: the full dynamic programme, ties to the earliest start."""
    n = len(v)
    if n < least or not np.isfinite(v).all():
        raise ValueError(f"segments need {least} finite values or more")
    s, q = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for e in range(least, n + 1):
        start = np.arange(0, e - least + 1)
        cost = best[start] + penalty + q[e] - q[start] - (s[e] - s[start]) ** 2 / (e - start)
        back[e] = int(cost.argmin())
        best[e] = cost[back[e]]
    out, e = [], n
    while e > 0:
        out.append(e)
        e = back[e]
    return out[::-1]


def segments(df: DataFrame, column: str, penalty: float = 8.0, least: int = 3) -> DataFrame:
    """(series_id, segment, start, end, mean, sse) of each series, half-open row ranges."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(TIME)[column].to_numpy()
        ends = pelt_ends(v, penalty, least)
        parts = [v[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return pd.DataFrame({KEY: g[KEY].iloc[0], "segment": range(len(ends)), "start": [0, *ends[:-1]], "end": ends, "mean": [p.mean() for p in parts], "sse": [((p - p.mean()) ** 2).sum() for p in parts]})

    return df.select(KEY, TIME, column).groupBy(KEY).applyInPandas(run, "series_id string, segment long, start long, end long, mean double, sse double")


def bocpd(v: np.ndarray, hazard: float = 0.02, mean: float = 0.0, variance: float = 1.0, precision: float = 1e-3) -> np.ndarray:
    """Per point the likeliest length of the run that it is in: Gaussian mean, known variance, constant hazard.

    A run that begins anew has absorbed no point yet, so its length is 0 there. Every run length is kept, so a series of n rows
    costs n * n steps; an observation that none of them allows raises.
    """
    weight, count, total, out = np.array([1.0]), np.array([0]), np.array([0.0]), []
    for x in v:
        own = precision + count / variance
        centre = (precision * mean + total / variance) / own
        spread = variance + 1 / own
        joint = weight * np.exp(-0.5 * (x - centre) ** 2 / spread) / np.sqrt(2 * np.pi * spread)
        weight = np.concatenate([[joint.sum() * hazard], joint * (1 - hazard)])
        z = weight.sum()
        if not z > 0:
            raise ValueError(f"an observation that no run length allows: {x}")
        weight = weight / z
        count, total = np.concatenate([[0], count + 1]), np.concatenate([[0.0], total + x])
        out.append(int(weight.argmax()))
    return np.array(out)


def run_lengths(df: DataFrame, column: str, **options) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        return g.assign(run_length=bocpd(g[column].to_numpy(), **options))

    rows = df.select(KEY, TIME, column)
    return rows.groupBy(KEY).applyInPandas(run, rows.withColumn("run_length", F.lit(0).cast("long")).schema)


def viterbi(start: np.ndarray, change: np.ndarray, emit: np.ndarray, seen: list[int]) -> list[int]:
    """The likeliest states of a discrete hidden Markov model, in logarithms."""
    with np.errstate(divide="ignore"):
        s, a, b = np.log(start), np.log(change), np.log(emit)
    score, back = s + b[:, seen[0]], []
    for x in seen[1:]:
        step = score[:, None] + a
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + b[:, x]
    path = [int(score.argmax())]
    for k in back[::-1]:
        path.append(int(k[path[-1]]))
    return path[::-1]


def hidden_states(df: DataFrame, symbol: str, start: np.ndarray, change: np.ndarray, emit: np.ndarray) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        return g.assign(state=viterbi(start, change, emit, g[symbol].astype(int).tolist()))

    rows = df.select(KEY, TIME, F.col(symbol).cast("int").alias(symbol))
    return rows.groupBy(KEY).applyInPandas(run, rows.withColumn("state", F.lit(0).cast("long")).schema)


def in_intervals(df: DataFrame, schedule: list[tuple[float, float, str]], column: str = TIME) -> DataFrame:
    """The label of the half-open interval that holds each row's time; a fixed schedule becomes one expression."""
    out = F.lit(None).cast("string")
    for a, b, name in schedule:
        out = F.when((F.col(column) >= a) & (F.col(column) < b), name).otherwise(out)
    return df.withColumn("regime", out)

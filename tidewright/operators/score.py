"""Scores of fits and the choice among candidates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import quantiles_by


def fit_statistics(df: DataFrame, observed: str, predicted: str, keys: list[str]) -> DataFrame:
    """n, mae, mse, rmse, rss and r2 by keys; r2 is 1 for a constant that is met, 0 for one that isn't."""
    e = F.col(observed) - F.col(predicted)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("rss"), (F.var_pop(observed) * F.count("*")).alias("tss"))
    r2 = F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).when(F.col("rss") == 0, 1.0).otherwise(0.0)
    return out.select(*keys, "n", "mae", (F.col("rss") / F.col("n")).alias("mse"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), "rss", r2.alias("r2"))


def information_criteria(n: Column, k: Column, rss: Column) -> dict[str, Column]:
    v = n * F.ln(F.greatest(rss / n, F.lit(2.2250738585072014e-308)))
    return {"aic": v + 2 * k, "aicc": F.when(n - k - 1 > 0, v + 2 * k + 2 * k * (k + 1) / (n - k - 1)), "bic": v + k * F.ln(n)}


def description_length(n: int, rss: float, nodes: int, symbols: int, constants: list[float]) -> float:
    """Two-part code length in nats: residuals under a Gaussian, then the expression and its constants."""
    v = max(rss / n, 2.2250738585072014e-308)
    return n / 2 * math.log(2 * math.pi * v) + rss / (2 * v) + nodes * math.log(11 + symbols) + sum(0.5 * math.log(n) + math.log(1 + abs(c)) for c in constants)


def pareto_front_2d(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other row beats on both, both to be small; equal rows stay together.

    The distinct values of first, each with its least second, meet a running minimum. To keep that off one task it is taken
    in slices of first, whose own minima are a small table.
    """
    least = df.groupBy(first).agg(F.min(second).alias("s_"))
    cut = least.withColumn("slice_", F.floor(F.log2(1 + F.abs(F.col(first))) * 8) * F.when(F.col(first) < 0, -1).otherwise(1))
    slices = cut.groupBy("slice_").agg(F.min("s_").alias("m_"), F.min(first).alias("f_"))
    before = slices.select("slice_", F.min("m_").over(Window.orderBy("f_").rowsBetween(Window.unboundedPreceding, -1)).alias("before_"))
    inside = F.min("s_").over(Window.partitionBy("slice_").orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    front = cut.join(before, "slice_").withColumn("least_", F.least(F.coalesce(inside, F.lit(float("inf"))), F.coalesce("before_", F.lit(float("inf"))))).where("s_ < least_").select(F.col(first).alias("f_"), "s_")
    return df.join(front, (F.col(first) == F.col("f_")) & (F.col(second) == F.col("s_")), "left_semi")


def pareto_front(points: list[tuple[float, ...]]) -> list[int]:
    """Indices of the points that no other is as good as everywhere and better somewhere."""
    return [i for i, p in enumerate(points) if not any(all(a <= b for a, b in zip(q, p, strict=True)) and q != p for q in points)]


def rank_candidates(df: DataFrame, mse: str, complexity: str, index: str, keep: int) -> DataFrame:
    return df.orderBy(mse, complexity, index).limit(keep)


def top_per_group(df: DataFrame, keys: list[str], order: list, keep: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    some = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    median = quantiles_by(df, value, keys, (0.5,)).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("q")[0].alias("median"))
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"{k}_")), keys, F.lit(True))
    return some.join(median, same, "left").select(*keys, "count", "mean", "median", "min", "max")


def set_scores(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of one set of keys against another, by a full outer join."""
    a, b = found.select(*keys).distinct().withColumn("a_", F.lit(1)), truth.select(*keys).distinct().withColumn("b_", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count_if(F.col("a_").isNotNull() & F.col("b_").isNotNull()).alias("both"), F.count("a_").alias("found"), F.count("b_").alias("truth"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    p, r = ratio(F.col("both"), F.col("found")), ratio(F.col("both"), F.col("truth"))
    return n.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))

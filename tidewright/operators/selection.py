"""The choice among candidate models: weights, fronts, description lengths, held-out folds, prices of complexity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, numbered
from . import sparse
from .features import Term, polynomial
from .gram import Gram
from .score import pareto_front_2d


def weighted_rank(df: DataFrame, error: str, complexity: str, index: str, error_weight: float, complexity_weight: float) -> DataFrame:
    """df with weighted, the weighted sum of error and complexity, in its order and that of index."""
    if not all(math.isfinite(w) and w >= 0 for w in (error_weight, complexity_weight)):
        raise ValueError("weights are finite and not negative")
    return df.withColumn("weighted", error_weight * F.col(error) + complexity_weight * F.col(complexity)).orderBy("weighted", index)


def most_parsimonious(df: DataFrame, total: str, index: str, keys: list[str]) -> DataFrame:
    """Of each group the row of least total description length, the first by index on ties."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(total, index)).alias("b"))
    return best.select(*keys, "b.*")


def loss_complexity_front(df: DataFrame, loss: str, complexity: str) -> DataFrame:
    return pareto_front_2d(df, loss, complexity)


def stable_front(df: DataFrame, error: str, complexity: str, stability: str) -> DataFrame:
    """Rows that no other row is as good as in error, complexity (small) and stability (large), and better in one.

    Rows of one triple stand or fall together, so distinct triples meet, and of those only the fronts of slices of error.
    """
    axes = [F.col(error), F.col(complexity), -F.col(stability)]
    own = df.select(*[a.alias(f"x{i}") for i, a in enumerate(axes)]).distinct()
    sliced = own.withColumn("s_", F.floor(F.log2(1 + F.abs("x0")) * 4))

    def beaten(rows: DataFrame, by: DataFrame, more: Column) -> DataFrame:
        worse = F.lit(True)
        for i in range(3):
            worse = worse & (F.col(f"q.x{i}") <= F.col(f"p.x{i}"))
        differ = (F.col("q.x0") < F.col("p.x0")) | (F.col("q.x1") < F.col("p.x1")) | (F.col("q.x2") < F.col("p.x2"))
        return rows.alias("p").join(by.alias("q"), more & worse & differ, "left_anti")

    inner = beaten(sliced, sliced, F.col("p.s_") == F.col("q.s_"))
    front = beaten(inner, inner, F.lit(True)).select("x0", "x1", "x2")
    same = (axes[0] == F.col("x0")) & (axes[1] == F.col("x1")) & (axes[2] == F.col("x2"))
    return df.join(front, same, "left_semi")


def stability_table(df: DataFrame, replicate: str, term: str) -> DataFrame:
    """(term, frequency, similarity): the share of replicates that select each term, and the mean Jaccard similarity of pairs of replicates.

    Shared terms of pairs are counted by a join on the term; replicates are a chosen number, tens or hundreds.
    """
    rows = df.select(F.col(replicate).alias("k_"), F.col(term).alias("t_")).distinct()
    sizes = rows.groupBy("k_").agg(F.count("*").alias("n_"))
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.t_") == F.col("b.t_")) & (F.col("a.k_") < F.col("b.k_"))).groupBy(F.col("a.k_").alias("p_"), F.col("b.k_").alias("q_")).agg(F.count("*").alias("c_"))
    met = both.join(sizes.select(F.col("k_").alias("p_"), F.col("n_").alias("m_")), "p_").join(sizes.select(F.col("k_").alias("q_"), "n_"), "q_")
    # Pairs that share nothing add nothing to the sum, but count.
    alike = met.agg(F.coalesce(F.sum(F.col("c_") / (F.col("m_") + F.col("n_") - F.col("c_"))), F.lit(0.0)).alias("s_"))
    total = sizes.agg(F.count("*").alias("r_")).crossJoin(F.broadcast(alike))  # one row each
    mean = F.coalesce(F.try_divide(F.col("s_"), F.col("r_") * (F.col("r_") - 1) / 2), F.lit(1.0))
    return rows.groupBy(F.col("t_").alias(term)).agg(F.count("*").alias("f_")).crossJoin(F.broadcast(total)).select(term, (F.col("f_") / F.col("r_")).alias("frequency"), mean.alias("similarity"))


def price_of_complexity(df: DataFrame, complexity: str, loss: str) -> Column:
    """-Cov / Var: how much loss a unit of complexity buys, on average."""
    return df.agg(F.regr_slope(loss, complexity).alias("slope"))


@dataclass
class Folds:
    """Gram sums of the library's rows, in each of k + 1 stretches of a series; unions of them train, single ones test."""

    parts: list[Gram]

    def train(self, j: int) -> Gram:
        return _added(self.parts[: j + 1])

    def test(self, j: int) -> Gram:
        return self.parts[j + 1]


def _added(parts: list[Gram]) -> Gram:
    total = lambda pick: sum(pick(p) for p in parts)
    return Gram(parts[0].names, total(lambda p: p.n), total(lambda p: p.g), total(lambda p: p.b), total(lambda p: p.yy), total(lambda p: p.y))


def fold_grams(df: DataFrame, terms: list[Term], target: Term, folds: int) -> Folds:
    """All sums of all stretches in one aggregate: stretch j has rows from floor(j n / (folds + 1)) to the next border."""
    rows = numbered(df)
    n = rows.count()
    border = [j * n // (folds + 1) for j in range(folds + 2)]
    part = F.lit(0)
    for j in range(1, folds + 1):
        part = F.when(F.col("rn_") >= border[j], j).otherwise(part)
    names = [f"x{i}_" for i in range(len(terms))] + ["y_"]
    wide = rows.select(part.alias("part_"), *[c.cast("double").alias(f"x{i}_") for i, (_, c) in enumerate(terms)], target[1].cast("double").alias("y_"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = wide.groupBy("part_").agg(F.count("*"), F.sum("y_"), *[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).orderBy("part_").collect()
    out, p = [], len(terms)
    for r in sums:
        full = np.zeros((p + 1, p + 1))
        full[np.triu_indices(p + 1)] = r[3:]
        full += np.triu(full, 1).T
        out.append(Gram([t for t, _ in terms], int(r[1]), full[:p, :p], full[:p, p:], full[p:, p].copy(), np.array([r[2]])))
    return Folds(out)


def _kept(m: Gram, names: list[str]) -> Gram:
    at = [m.names.index(n) for n in names]
    return Gram(names, m.n, m.g[np.ix_(at, at)], m.b[at], m.yy, m.y)


def select_model(df: DataFrame, variables: list[str], target: Term, degrees: list[int], thresholds: list[float], folds: int = 3) -> DataFrame:
    """(index, degree, threshold, fold_score, terms, chosen): every degree and threshold by its mean held-out mean squared error.

    The rows are read once, for the largest degree: each candidate's sums are part of those. Folds go forward in time. Ties go to the
    lower degree, the higher threshold, fewer terms, the lower index; a candidate whose solver fails on a fold has no score.
    """
    wide = fold_grams(df, polynomial(variables, max(degrees)), target, folds)
    rows = []
    for degree in degrees:
        names = [n for n, _ in polynomial(variables, degree)]
        for threshold in thresholds:
            scores, terms = [], 0
            for j in range(folds):
                train, test = _kept(wide.train(j), names), _kept(wide.test(j), names)
                try:
                    c = sparse.SOLVERS["stlsq"](train, threshold=threshold)
                except (ValueError, np.linalg.LinAlgError):
                    continue
                scores.append(float(test.yy[0] - 2 * c @ test.b[:, 0] + c @ test.g @ c) / test.n)
                terms = int(np.count_nonzero(c))
            rows.append([len(rows), degree, float(threshold), sum(scores) / len(scores) if scores else None, terms])
    scored = [r for r in rows if r[3] is not None]
    best = min(scored, key=lambda r: (round(r[3], 12), r[1], -r[2], r[4], r[0]))[0] if scored else -1
    schema = "index int, degree int, threshold double, fold_score double, terms int, chosen boolean"
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], schema)


def auto_parsimony(m: Gram, thresholds: list[float], target: int = 0) -> dict:
    """The threshold of least loss plus price times complexity, the price being the slope of loss on complexity over the sweep."""
    rows = []
    for t in thresholds:
        c = sparse.SOLVERS["stlsq"](m, threshold=t)
        rows.append((float(t), int(np.count_nonzero(c)), float(m.yy[target] - 2 * c @ m.b[:, target] + c @ m.g @ c) / m.n))
    size, loss = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    spread = ((size - size.mean()) ** 2).sum()
    price = abs(((size - size.mean()) * (loss - loss.mean())).sum() / spread) if spread > 0 else 0.0
    best = min(rows, key=lambda r: (r[2] + price * r[1], r[1], -r[0]))
    return {"threshold": best[0], "terms": best[1], "loss": best[2], "price": float(price), "sweep": rows}


def subsample_ensemble(df: DataFrame, terms: list[Term], target: Term, members: int, share: float, seed: int, threshold: float) -> DataFrame:
    """(term, frequency, mean, deviation) of sparse laws over seeded subsamples of the rows; one aggregate for all members.

    A row is in a member by a hash of seed, member and row, so a member holds about that share and any cluster draws the same.
    """
    rows = numbered(df)
    names = [f"x{i}_" for i in range(len(terms))] + ["y_"]
    wide = rows.select(F.col(KEY), "rn_", *[c.cast("double").alias(f"x{i}_") for i, (_, c) in enumerate(terms)], target[1].cast("double").alias("y_"))
    drawn = wide.withColumn("member_", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).where(F.pmod(F.xxhash64(F.lit(seed), "member_", KEY, "rn_"), F.lit(1_000_000)) < int(share * 1_000_000))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = drawn.groupBy("member_").agg(F.count("*"), F.sum("y_"), *[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).orderBy("member_").collect()
    p, found = len(terms), []
    for r in sums:
        full = np.zeros((p + 1, p + 1))
        full[np.triu_indices(p + 1)] = r[3:]
        full += np.triu(full, 1).T
        found.append(sparse.SOLVERS["stlsq"](Gram([t for t, _ in terms], int(r[1]), full[:p, :p], full[:p, p:], full[p:, p].copy(), np.array([r[2]])), threshold=threshold))
    c = np.array(found)
    rows_ = [(n, float((c[:, i] != 0).mean()), float(c[:, i].mean()), float(c[:, i].std(ddof=1)) if len(c) > 1 else 0.0) for i, (n, _) in enumerate(terms)]
    return df.sparkSession.createDataFrame(rows_, "term string, frequency double, mean double, deviation double")

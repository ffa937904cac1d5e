"""Normal equations in one distributed aggregate: p x p sums go to the driver, rows never do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import Term

#: Terms and targets whose sums are one aggregate's expressions; of more, tasks sum products of whole batches.
MOST_TERMS = 400


@dataclass
class Gram:
    names: list[str]
    n: int
    g: np.ndarray  # p x p
    b: np.ndarray  # p x q
    yy: np.ndarray  # q
    y: np.ndarray  # sums of the targets

    def solve(self, active: list[int], target: int = 0, ridge: float = 1e-10, penalty: float = 0.0, prior: np.ndarray | None = None) -> np.ndarray:
        """(G + (ridge + penalty) I) c = b + penalty * prior over the active terms, zeros elsewhere."""
        out = np.zeros(len(self.names))
        if active:
            a = np.array(active)
            rhs = self.b[a, target] + (penalty * prior[a] if prior is not None else 0)
            m = self.g[np.ix_(a, a)] + (ridge + penalty) * np.eye(len(a))
            try:
                out[a] = np.linalg.solve(m, rhs)
            except np.linalg.LinAlgError:
                out[a] = np.linalg.lstsq(m, rhs, rcond=None)[0]
        return out

    def scaled(self) -> tuple[Gram, np.ndarray]:
        """The same with every term divided by its root mean square, and those."""
        s = np.sqrt(np.diag(self.g) / max(self.n, 1))
        s = np.where(s > 0, s, 1.0)
        return Gram(self.names, self.n, self.g / np.outer(s, s), self.b / s[:, None], self.yy, self.y), s

    def rss(self, c: np.ndarray, target: int = 0) -> float:
        """From the sums; near a perfect fit residual_sums, in a second pass, keeps more digits."""
        return float(max(self.yy[target] - 2 * c @ self.b[:, target] + c @ self.g @ c, 0.0))


def gram(df: DataFrame, terms: list[Term], targets: list[Term]) -> Gram:
    p, q = len(terms), len(targets)
    x = df.select(*[c.cast("double").alias(f"x{i}") for i, (_, c) in enumerate(terms)], *[c.cast("double").alias(f"y{j}") for j, (_, c) in enumerate(targets)]).dropna()
    if p + q > MOST_TERMS:
        return _wide(x, [n for n, _ in terms], q)
    pairs = [(f"x{i}", f"x{j}") for i in range(p) for j in range(i, p)] + [(f"x{i}", f"y{j}") for i in range(p) for j in range(q)] + [(f"y{j}", f"y{j}") for j in range(q)]
    row = x.agg(F.count("*"), *[F.sum(F.col(a) * F.col(b)) for a, b in pairs], *[F.sum(f"y{j}") for j in range(q)]).first()
    v = np.array([0.0 if r is None else float(r) for r in row[1:]])
    m = p * (p + 1) // 2
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = v[:m]
    g = g + np.triu(g, 1).T
    return Gram([n for n, _ in terms], int(row[0]), g, v[m : m + p * q].reshape(p, q), v[m + p * q : m + p * q + q], v[m + p * q + q :])


def _wide(x: DataFrame, names: list[str], q: int) -> Gram:
    """The same sums where there are too many for expressions: each task adds up products of its batches, and sends one matrix by rows."""
    p = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p + q, p + q + 1)), 0
        for batch in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, p + q))
            total[:, :-1] += m.T @ m
            total[:, -1] += m.sum(axis=0)
            n += len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(p + q), pa.int32()), pa.array([n] * (p + q), pa.int64()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "n", "s"])

    sums = x.mapInArrow(run, "i int, n long, s array<double>").select("i", "n", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    full, n = np.zeros((p + q, p + q + 1)), int(sums.column("n")[0].as_py()) if sums.num_rows else 0
    full[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return Gram(names, n, full[:p, :p], full[:p, p:-1], np.diag(full[p:, p:-1]).copy(), full[p:, -1])


def fitted(terms: list[Term], c: np.ndarray) -> Column:
    out = F.lit(0.0)
    for (_, column), k in zip(terms, c.tolist(), strict=True):
        if k:
            out = out + F.lit(k) * column
    return out


def residual_sums(df: DataFrame, terms: list[Term], c: np.ndarray, target: Column) -> dict[str, float]:
    """n, rss, mae, largest residual and tss of a fit, in one pass over the rows."""
    rows = df.select(target.alias("y_"), (target - fitted(terms, c)).alias("e_")).dropna()
    mean = rows.agg(F.avg("y_")).first()[0] or 0.0
    r = rows.agg(F.count("*").alias("n"), F.sum(F.col("e_") * F.col("e_")).alias("rss"), F.avg(F.abs("e_")).alias("mae"), F.max(F.abs("e_")).alias("most"), F.sum(F.pow(F.col("y_") - mean, 2)).alias("tss")).first()
    return {k: float(v or 0) for k, v in r.asDict().items()}

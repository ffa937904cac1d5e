"""Connected components of links, as joins and aggregates: no link, component or document goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

#: A node with more neighbours than HOT, and more than a share of 1 / MOST_HOT of all, does not meet them in one task.
HOT, MOST_HOT = 512, 20_000


class UnionFind:
    """Over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as stars about the smallest node of each of the batch's own components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        nodes, at = np.unique(ends, return_inverse=True)
        uf = UnionFind(len(nodes))
        for x, y in at.reshape(2, -1).T.tolist():
            uf.join(x, y)
        roots = np.array([uf.root(i) for i in range(len(nodes))])
        own = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], ["u", "v"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(src long, dst long) -> (id, component): the smallest id reachable; for ids that have a link to another.

    Alternates large-star and small-star steps (both lead each node's neighbours to its smallest one) until every
    component is one star, after a number of rounds that grows with the logarithm of its diameter. Links with a null end
    or to themselves are none; repeated links count once; no links give no rows.
    """
    edges = links.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    edges = materialize(edges.mapInArrow(_stars, "u long, v long").distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        hot = max(HOT, 2 * before[0] // MOST_HOT)
        both = edges.union(edges.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both.where("v > u"), least, "u", "n", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
        lowest = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(down, lowest, "u", "n", hot).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())

"""Directed graphs of dependence, as tables of edges (src, dst)."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skeleton(edges: DataFrame) -> DataFrame:
    """(a, b) of the unordered pairs that an edge joins."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def colliders(edges: DataFrame) -> DataFrame:
    """(left, middle, right): two parents of a node that no edge joins, left before right. With the skeleton they name the Markov equivalence class."""
    e = edges.select("src", "dst").distinct()
    pairs = e.alias("p").join(e.alias("q"), (F.col("p.dst") == F.col("q.dst")) & (F.col("p.src") < F.col("q.src"))).select(F.col("p.src").alias("left"), F.col("p.dst").alias("middle"), F.col("q.src").alias("right"))
    return pairs.join(skeleton(e), (F.col("left") == F.col("a")) & (F.col("right") == F.col("b")), "left_anti")


def topological_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Parents first; of those that are ready, the first by name. Raises for a cycle."""
    left = {n: 0 for n in nodes}
    out: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in set(edges):
        out[a].add(b)
        left[b] += 1
    ready = [n for n, k in left.items() if not k]
    heapq.heapify(ready)
    order = []
    while ready:
        order.append(n := heapq.heappop(ready))
        for b in out[n]:
            left[b] -= 1
            if not left[b]:
                heapq.heappush(ready, b)
    if len(order) < len(nodes):
        raise ValueError("the graph has a cycle")
    return order


def layers(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """nodes(id), edges(src, dst) -> (id, layer): the length of the longest path to each node, one join a layer. Raises for a cycle."""
    known = nodes.select("id").distinct().withColumn("layer", F.lit(0))
    frontier, out = known, known
    for k in range(1, most + 1):
        frontier = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().withColumn("layer", F.lit(k))
        frontier = frontier.checkpoint() if nodes.sparkSession.sparkContext.getCheckpointDir() and k % 10 == 0 else frontier
        if frontier.isEmpty():
            return out.groupBy("id").agg(F.max("layer").alias("layer"))
        out = out.union(frontier)
    raise ValueError("the graph has a cycle, or more layers than allowed")

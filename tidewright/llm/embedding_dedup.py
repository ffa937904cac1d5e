"""Embedding near-dedup: a forest of random-projection trees with spill.

1. Vectors become unit vectors in double precision; rows with the same vector and label form one class with a weight.
   They travel as they came, in 32 bits where that loses nothing, and are scaled where they are compared.
2. TREES trees split all vectors by seeded random directions, one for each level of a tree, at medians that a sample of at
   most SAMPLE vectors gives (of each node for the first FITTED levels, of the level below). Two unit vectors at the threshold's cosine c
   are sqrt(2 - 2c) apart, and their projections differ by a deviation of that over sqrt(dimension); a vector within
   SPILL of those deviations of a threshold goes to both sides. So a pair that links is separated at a level with a chance of about
   1 %, and by all TREES trees of 8 levels with one of about 1e-3. Levels grow with the largest label's vectors, without a bound; a
   vector has about 1.9 copies a tree at 8 levels, 2.5 at 12. They are counted first, so that they are sent once and never written. Tasks get the vectors by (tree, leaf, label), go on splitting their own
   until LEAF are left, and compare within leaves. A group larger than GROUP (one label's, where splits no longer part it) is cut into parts,
   each pair of parts a task.
3. Tasks give a spanning forest of links of cosine >= threshold, confirmed in double precision; components unite them.
4. All links of a vector lie in its component, so their number is counted there exactly, in blocks, not by the trees.

Nulls and odd rows: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label link with
nothing and are their own component; vectors of different lengths do not link; repeated vectors link with each other;
rows with a null vec_id keep their row and link with nothing; a repeated vec_id with one vector counts each of its rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, materialize
from .components import UnionFind, components

TREES, SPILL, LEAF, GROUP, SAMPLE, FITTED = 3, 0.5, 192, 4096, 20_000, 8


def spill(threshold: float, dim: int) -> float:
    """How near to a split a vector goes to both sides."""
    return SPILL * np.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def unit(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    n = np.sqrt(v @ v)
    return v / n if np.isfinite(n) and n > 0 else None


def packed(vector: list) -> bytes:
    """A vector's components: 32-bit where that is exact, else 64-bit, told apart by the first byte."""
    wide = np.array(vector, np.float64)
    with np.errstate(over="ignore"):
        narrow = wide.astype(np.float32)
    return b"\4" + narrow.tobytes() if (narrow == wide).all() else b"\10" + wide.tobytes()


def unpacked(raw: list[bytes]) -> np.ndarray:
    """Unit vectors, of one length, in double precision."""
    if not raw:
        return np.empty((0, 0))
    out = np.array([np.frombuffer(r, np.float32 if r[0] == 4 else np.float64, offset=1) for r in raw], np.float64)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def dimension(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(1).to_pylist()
        units = [unit(v) for v in vectors]
        keys = [None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in units]
        raw = [None if u is None else packed(v) for u, v in zip(units, vectors, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "vec_key", "raw"])


def directions(tree: int, levels: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([7_919, tree, dim]).standard_normal((levels, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def fit(sample: np.ndarray, tree: int, depth: int) -> list[np.ndarray]:
    """Per level the threshold of each node, the median of the sample there; from level FITTED on one for the level, so that a tree stays small."""
    node, out = np.zeros(len(sample), int), []
    for level, d in enumerate(directions(tree, depth, sample.shape[1]) if depth else []):
        p = sample @ d
        at = np.full(1 << level if level < FITTED else 1, np.median(p))
        for n in np.unique(node).tolist() if level < FITTED else ():
            at[n] = np.median(p[node == n])
        out.append(at)
        node = node * 2 + (p > at[node if level < FITTED else 0])
    return out


def descend(vectors: np.ndarray, tree: int, thresholds: list[np.ndarray], near_by: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each vector, more than one leaf where it spills."""
    row, node = np.arange(len(vectors)), np.zeros(len(vectors), int)
    for d, at in zip(directions(tree, len(thresholds), vectors.shape[1]), thresholds, strict=True) if thresholds else []:
        gap = (vectors @ d)[row] - (at[node] if len(at) > 1 else at[0])
        left, right = gap <= near_by, gap > -near_by
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
    return row, node


_DEALT = "tree int, leaf long, dim int, vec_id long, label string"


def _assign(models: dict[int, list[list[np.ndarray]]], threshold: float, whole: bool):
    """models: by dimension the thresholds of each tree; vectors of a dimension that the sample lacks go to one leaf. whole: with the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                raw = part.column(2).to_pylist()
                dims = np.array([dimension(r) for r in raw])
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    vectors = unpacked([raw[i] for i in own.tolist()])
                    for tree, thresholds in enumerate(models.get(dim, [[]])):
                        row, leaf = descend(vectors, tree, thresholds, spill(threshold, dim))
                        take = part.take(pa.array(own[row]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree), pa.int32()), pa.array(leaf, pa.int64()), pa.array(np.full(len(row), dim), pa.int32()), *(take.column(k) for k in range(2 + whole))], ["tree", "leaf", "dim", "vec_id", "label", *["raw"] * whole])

    return run


def near(vectors: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    out = np.empty((len(vectors), len(others)), bool)
    for at in range(0, len(vectors), 512):
        out[at : at + 512] = vectors[at : at + 512] @ others.T >= threshold
    return out


def forest(ids: np.ndarray, vectors: np.ndarray, threshold: float, out: list[np.ndarray]) -> None:
    """Adds a spanning forest of the links among vectors, breadth first."""
    linked, waiting = near(vectors, vectors, threshold), np.ones(len(ids), bool)
    for s in np.flatnonzero(linked.sum(axis=1) > 1).tolist():
        if not waiting[s]:
            continue
        waiting[s], queue = False, [s]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & waiting)
            waiting[new] = False
            queue += new.tolist()
            if len(new):
                out.append(np.stack([np.full(len(new), ids[x]), ids[new]]))


def split(ids: np.ndarray, vectors: np.ndarray, threshold: float, rng: np.random.Generator, out: list[np.ndarray], depth: int = 0) -> None:
    """Goes on splitting at medians, with spill, until LEAF vectors are left or a split no longer parts them."""
    if len(ids) > LEAF and depth < 40:
        p = vectors @ (d := rng.standard_normal(vectors.shape[1])) / np.linalg.norm(d)
        gap, near_by = p - np.median(p), spill(threshold, vectors.shape[1])
        left, right = gap <= near_by, gap > -near_by
        if left.sum() + right.sum() < 1.2 * len(ids):  # what lies too close to be parted is compared as it is
            split(ids[left], vectors[left], threshold, rng, out, depth + 1)
            split(ids[right], vectors[right], threshold, rng, out, depth + 1)
            return
    forest(ids, vectors, threshold, out)


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        vectors = unpacked(group.column("raw").to_pylist())
        out: list[np.ndarray] = [np.empty((2, 0), np.int64)]
        split(ids, vectors, threshold, np.random.default_rng([104_729, group.column("tree")[0].as_py()]), out)
        # Leaves overlap: of their links, no more than one for each vector is needed.
        ends, at = np.unique(np.concatenate(out, axis=1), return_inverse=True)
        uf = UnionFind(len(ends))
        links = [(x, y) for x, y in at.reshape(2, -1).T.tolist() if uf.join(x, y)]
        return pa.table({"src": pa.array([ends[x] for x, _ in links], pa.int64()), "dst": pa.array([ends[y] for _, y in links], pa.int64())})

    return run


def _count(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        ids, w, side = (group.column(k).to_numpy() for k in ("vec_id", "weight", "side"))
        vectors = unpacked(group.column("raw").to_pylist())
        n, two = np.zeros(len(ids), np.int64), group.column("low")[0].as_py() != group.column("high")[0].as_py()
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
        linked = near(vectors[a], vectors[b], threshold)
        n[a] += (linked * w[b]).sum(axis=1)
        if two:
            n[b] += (linked * w[a][:, None]).sum(axis=0)
        elif len(a):
            n[a] -= linked.diagonal() * w[a]
        return pa.table({"rep": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _in_parts(rows: DataFrame, keys: list[str], size: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows with low, high and side: groups of more than size rows in parts, one copy of a row for each part it meets.

    counted: the rows without what is long, where counting the rows themselves would be dear.
    """
    sizes = materialize((rows if counted is None else counted).groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("parts")).where("parts > 1"), "parts")
    # Groups of more than size rows: at most one for each size rows.
    few = sizes.count() <= MOST_BROADCAST
    placed = rows.join(F.broadcast(sizes) if few else sizes, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*rows.columns, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept; see the module."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ready = materialize(plain.mapInArrow(_prepare, "vec_id long, label string, vec_key binary, raw binary"), "units")
    live = ready.where("vec_id IS NOT NULL AND label IS NOT NULL AND raw IS NOT NULL")
    classes = materialize(live.groupBy("label", "vec_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("raw").alias("raw")), "classes")
    reps = classes.select(F.col("rep").alias("vec_id"), "label", "raw")
    n, most = reps.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    depth = max(0, int(np.ceil(np.log2(max(most or 0, 1) / GROUP))))
    models: dict[int, list[list[np.ndarray]]] = {}
    # At most SAMPLE vectors, taken by the hash of their id: medians need no more.
    share = min(1.0, 1.2 * SAMPLE / max(n or 0, 1))
    sample = reps.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("raw").limit(SAMPLE).toArrow().column(0).to_pylist()
    for dim in {dimension(r) for r in sample}:
        own = unpacked([r for r in sample if dimension(r) == dim])
        models[dim] = [fit(own, tree, depth) for tree in range(trees)]
    leaves = reps.mapInArrow(_assign(models, threshold, True), _DEALT + ", raw binary")
    counted = reps.mapInArrow(_assign(models, threshold, False), _DEALT)
    tasks = _in_parts(leaves, ["tree", "leaf", "dim", "label"], GROUP, counted)
    links = tasks.groupBy("tree", "leaf", "dim", "label", "low", "high").applyInArrow(_compare(threshold), "src long, dst long")
    groups = materialize(components(materialize(links, "links")), "groups")
    members = classes.join(groups, F.col("rep") == F.col("id")).select("component", F.col("rep").alias("vec_id"), "weight", "raw")
    counts = _in_parts(members, ["component"], GROUP).groupBy("component", "low", "high").applyInArrow(_count(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select(F.col("label").alias("label_"), F.col("vec_key").alias("key_"), "rep", "weight").join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "rep", "left")
    joined = ready.join(named, F.col("vec_id").isNotNull() & (F.col("label") == F.col("label_")) & (F.col("vec_key") == F.col("key_")), "left")
    component = F.coalesce("component", "rep", "vec_id")
    return joined.select("vec_id", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

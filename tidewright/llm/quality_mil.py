"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. Each passage is encoded: shares of kinds of characters,
how its words repeat (next to each other, within it, and of what the document said before), and a hashed projection of its words, through a tanh layer.
Gated attention, w . (tanh(V e) * sigmoid(U e)), learned from document labels alone, weighs the passages; the score is a logistic function of the
weighted mean of their encodings.

Fitted on at most BAGS labelled documents, chosen by a hash of doc_id, at most BAG passages of each, evenly spaced (of a repeated doc_id, the texts of least hash); scoring takes every
passage. Neither labels, lang, source nor doc_id is an input of a score.

Nulls and odd rows: a null text is an empty one, an empty passage, and is scored; a null doc_id is scored and never learned
from; labels other than 0 and 1, or null, are no labels; a doc_id labelled twice counts twice; other columns are
ignored or kept as they are; an empty table gives no rows; without labels of both kinds every score is 1, so nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, passages, segment_sums
from .common import only

PASSAGE, HASHED, ENCODED, GATE, BAGS, BAG, STEPS = 64, 16, 16, 8, 3000, 128, 250

_KIND = np.zeros((256, 6), np.float32)  # upper, digit, bar, sentence mark, other ASCII mark, letter or other byte
for _b in range(256):
    _c = chr(_b)
    _KIND[_b, 0 if 65 <= _b <= 90 else 1 if 48 <= _b <= 57 else 2 if _c == "|" else 3 if _c in ".,;:!?'\"()-" else 4 if 32 < _b < 127 and not _c.isalpha() else 5] = 1
_MIXER = np.random.default_rng(49_979_687).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = 6 + 6 + HASHED


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text of each passage, passage x FEATURES)."""
    words = Words(texts)
    raw, offsets = words.raw()
    u, n = len(words.distinct), len(words.codes)
    if u:
        length = np.diff(offsets).astype(np.int64)
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], length)
        kinds = np.stack([np.add.reduceat(_KIND[:, k][raw], offsets[:-1]) for k in range(6)], axis=1)
        h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _MIXER[place & 63], offsets[:-1])
        signs = ((h[:, None] >> np.arange(20, 20 + HASHED, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
        table = np.concatenate([kinds, length[:, None].astype(np.float32), signs], axis=1)
    else:
        table = np.empty((0, 7 + HASHED), np.float32)
    owner, at = passages(words.at, PASSAGE)
    size = np.diff(at)
    sums = np.empty((len(owner), table.shape[1]))
    codes = words.codes
    for k in range(table.shape[1]):  # a column at a time bounds memory
        sums[:, k] = segment_sums(table[:, k][codes].astype(np.float64), at)
    own = np.repeat(np.arange(len(owner)), size)
    same = np.zeros(n)
    same[1:] = (codes[1:] == codes[:-1]) & (own[1:] == own[:-1])
    text = words.owner().astype(np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    # Words new to their passage, and pairs of words new to their document.
    fresh, new = np.zeros(n), np.zeros(n)
    if n:
        fresh[np.unique(own.astype(np.uint64) * np.uint64(1 << 32) + c, return_index=True)[1]] = 1
        pair = c * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([c[1:], c[:1]]) * np.uint64(0xC2B2AE3D27D4EB4F) + text * np.uint64(0x165667B19E3779F9)
        new[np.unique(pair, return_index=True)[1]] = 1
    chars = np.maximum(sums[:, 6], 1)
    count = np.maximum(size, 1)
    more = [sums[:, 6] / count / 10, segment_sums(same, at) / count, segment_sums(fresh, at) / count, segment_sums(new, at) / count, np.log1p(size) / 4, size == 0]
    return owner, np.concatenate([sums[:, :6] / chars[:, None], np.stack(more, axis=1), sums[:, 7:] / np.sqrt(count)[:, None] / 4], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, rng: np.random.Generator | None = None):
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), None
        if rng is not None:
            g = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
            self.weights = {"E": g(FEATURES, ENCODED), "e": np.zeros(ENCODED), "V": g(ENCODED, GATE), "U": g(ENCODED, GATE), "w": g(GATE), "c": g(ENCODED), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict:
        p = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        e = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        a = np.exp(np.clip((t * s) @ p["w"], -30, 30))
        a /= np.bincount(owner, a, bags)[owner]
        at = np.searchsorted(owner, np.arange(bags + 1))
        z = segment_sums(e * a[:, None], at)
        return {"x": x, "e": e, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, x: np.ndarray, owner: np.ndarray, bags: int) -> np.ndarray:
        return self.forward(x, owner, bags)["y"] if self.weights else np.ones(bags)

    def gradient(self, f: dict, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, n = self.weights, weight.sum()
        d = (f["y"] - y) * weight / n
        dz = d[:, None] * p["c"]
        de = f["a"][:, None] * dz[owner]
        da = (f["e"] * dz[owner]).sum(axis=1)
        dl = f["a"] * (da - np.bincount(owner, f["a"] * da, len(y))[owner])
        g = dl[:, None] * p["w"]
        dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
        de += dt @ p["V"].T + ds @ p["U"].T
        du = de * (1 - f["e"] ** 2)
        return {"E": f["x"].T @ du, "e": du.sum(axis=0), "V": f["e"].T @ dt, "U": f["e"].T @ ds, "w": (f["t"] * f["s"]).T @ dl, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 11) -> Model:
    """Full-batch Adam; owner counts up from 0; both classes weigh as they are found."""
    if len(np.unique(y)) < 2:
        return Model()
    m = Model(np.random.default_rng(seed))
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    first, second = ({k: np.zeros_like(v) for k, v in m.weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        g = m.gradient(m.forward(x, owner, len(y)), owner, y, np.ones(len(y)))
        for k, v in m.weights.items():
            d = g[k] + (2e-4 * v if k not in "eb" else 0)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            m.weights[k] = v - 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bags: int = BAGS) -> Model:
    """Learns from at most bags labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y")).where("label_id IS NOT NULL AND y IN (0, 1)").where(~held_out("label_id"))
    chosen = known.orderBy(F.xxhash64("label_id", F.lit(17)), "label_id", "y").limit(bags)  # bounded by the parameter, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(17)), F.xxhash64("text"), "y").limit(bags)  # a repeated doc_id does not make them more

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, x = encode_passages(part.column(2))
                bags = np.split(x, np.searchsorted(owner, np.arange(1, part.num_rows)))
                bags = [b if len(b) <= BAG else b[np.linspace(0, len(b) - 1, BAG).astype(int)] for b in bags]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.astype(np.float32).tobytes() for b in bags], pa.binary())], ["doc_id", "y", "bag"])

    found = rows.select("doc_id", "y", "text").mapInArrow(encode, "doc_id long, y int, bag binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not found.num_rows:
        return Model()
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found.column("bag").to_pylist()]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return train(np.concatenate(parts).astype(np.float64), owner, found.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of the scores, in place of any of that name; every passage of every text."""
    columns = [c for c in docs.columns if c != name]
    where = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                owner, x = encode_passages(part.column(where).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x, owner, part.num_rows), pa.float64())], [*columns, name])

    plain = docs.select(*columns)
    return plain.mapInArrow(run, plain.withColumn(name, F.lit(0.0)).schema)

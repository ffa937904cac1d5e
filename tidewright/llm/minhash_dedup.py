"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures.

1. Each text's set of word shingles gives a signature of POSITIONS minima, BITS bits of each. Rows with the same set form one
   class; one of its texts stands for it from here on.
2. The signature is split into CHUNKS. If two signatures differ in at most RADIUS places, then by the pigeonhole principle
   some chunk differs in at most RADIUS // CHUNKS = 1 places; so one key for each chunk and each place left out of it,
   made from the other places, is shared by every such pair. At a Jaccard similarity of 0.85 a pair differs in more than
   RADIUS of 64 places with a chance of about 5e-4, and then still shares a key almost always.
3. Classes that share keys, directly or by way of others, form a family: a star per key, linear in the rows. Every
   link lies inside a family.
4. Families are compared: pairs whose signatures differ in at most SLACK places (8 deviations beyond the mean at 0.8, so
   that the Hamming test rules out what merely shares a family and no link) are confirmed on full sets; postings of each shingle count
   the intersections. What comes out is a spanning forest of the confirmed links, not all pairs: the row nearest to all
   others is met first, and only rows outside the largest set go on searching, so a large group of near copies costs what it holds, not its square.
5. A family of more than FAMILY shingles is cut into parts, to each of which its most connected class is added; what
   that does not unite with it meets all parts, in parts of its own. Components of the links are the groups.

Nulls and odd rows: a null, empty or all-white text has no shingles and links with nothing; rows with a null doc_id
keep a row of their own and link with nothing; repeated rows share a class and each keeps its row; a doc_id with several
texts links by each of them; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _odd_powers, join_hot, materialize, mix, only, only_ids, split_words, window_hashes, without_ids, word_hashes
from .components import HOT, MOST_HOT, components

POSITIONS, BITS, CHUNKS, RADIUS, SLACK, FAMILY = 64, 16, 10, 19, 40, 250_000
_MULTIPLIERS = _odd_powers(POSITIONS, 30_011)
_BORDERS = np.linspace(0, POSITIONS, CHUNKS + 1).round().astype(int)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; a shorter text is one shingle; none without words."""
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(k, len(h))))


def signature(shingles: np.ndarray) -> bytes:
    """The low BITS of the minimum of each of POSITIONS hash functions."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = np.multiply.outer(_MULTIPLIERS, shingles[at : at + 2048])
        np.minimum(least, part.min(axis=1), out=least)
    return mix(least).astype("<u2").tobytes()


def keys(signatures: np.ndarray) -> np.ndarray:
    """rows x POSITIONS signature values -> rows x POSITIONS keys: key j has place j left out of its chunk."""
    values = mix(signatures.astype(np.uint64) + (np.arange(POSITIONS, dtype=np.uint64) << np.uint64(BITS)))
    out = np.empty_like(values)
    for a, b in zip(_BORDERS, _BORDERS[1:], strict=False):
        # Places are told apart by their number within values, so sums of them are sets of (place, value).
        out[:, a:b] = values[:, a:b].sum(axis=1, keepdims=True) - values[:, a:b] + np.arange(a, b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, k)
                    rows.append((len(s), digest(s), signature(s) if len(s) else None))
                n, d, g = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(g, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("words")
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, POSITIONS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys(sig).ravel().view(np.int64)), pa.array(np.repeat(ids, POSITIONS))], ["key", "cid"])


def linked(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def distances(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Places in which each signature differs from one."""
    return (signatures != one).sum(axis=1)


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows; those of one label are in one set from the start.

    A pair need not be looked at if both rows are in one set already. So the row nearest to the most common signature is
    compared with all others first, and then one row after another that is not in the largest set, until all that have
    not been compared are in one set. Intersection sizes come from the postings of each shingle: exact, without a
    comparison of sets that share nothing.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(term.max() + 2))
    posted, at = owner[order], np.concatenate([[0], np.cumsum(sizes)])
    common = np.array([np.bincount(signatures[:, j]).argmax() for j in range(signatures.shape[1])], signatures.dtype)
    label = np.unique(labels, return_inverse=True)[1]
    waiting, out = np.ones(n, bool), []
    i = int(distances(signatures, common).argmin())
    while True:
        waiting[i] = False
        able = (label != label[i]) & (distances(signatures, signatures[i]) <= SLACK)
        if able.any():
            both = np.bincount(np.concatenate([posted[starts[t] : starts[t + 1]] for t in term[at[i] : at[i + 1]].tolist()]), minlength=n)
            for j in np.flatnonzero(able & linked(sizes[i], sizes, both, percent) & (both > 0)).tolist():
                if label[j] != label[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    label[label == label[j]] = label[i]
        if not waiting.any():
            return out
        largest = np.bincount(label[waiting]).argmax()
        left = waiting & (label != largest)
        if not left.any():
            return out
        i = int(left.argmax())


def _compare(k: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        only("words")
        ids, keys = group.column("cid").to_numpy(), group.column("set_key").to_pylist()
        rows, sets, known = [], [], set()
        for i, (cid, key, text) in enumerate(zip(ids.tolist(), keys, group.column("text").to_pylist(), strict=True)):
            if cid not in known and digest(s := shingle_set(text, k)) == key:  # a doc_id may have other texts too
                known.add(cid)
                rows.append(i)
                sets.append(s)
        raw = group.column("sig").to_pylist()
        signatures = np.frombuffer(b"".join([raw[i] for i in rows]), "<u2").reshape(-1, POSITIONS)
        links = spanning_links(ids[rows], sets, signatures, group.column("label").to_numpy()[rows], percent)
        return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, family: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; see the module."""
    family = family or FAMILY
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = materialize(docs.mapInArrow(_features(k), "doc_id long, n_shingles long, set_key binary, sig binary"), "signatures")
    known = features.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbers that stay as written
    keyed = materialize(classes.select("cid", "sig").mapInArrow(_explode_keys, "key long, cid long"), "keys")
    shared = materialize(keyed.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"), F.count("*").alias("n")).where("lead < last").drop("last"), "shared")
    hot = lambda x: max(HOT, (x.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    met = materialize(join_hot(keyed, shared, "key", "n", hot(shared)).select("cid", "lead", "n"), "met")
    families = components(met.where("cid != lead").select(F.col("lead").alias("src"), F.col("cid").alias("dst"))).withColumnRenamed("component", "family")
    families = families.join(classes.select(F.col("cid").alias("id"), "rep", "set_key", "sig", "n_shingles"), "id")
    families = materialize(families.withColumnRenamed("id", "cid"), "families")
    parts = families.groupBy("family").agg(F.ceil(F.sum("n_shingles") / family).cast("int").alias("parts"), F.count("*").alias("n"))
    parts = materialize(parts, "parts")
    placed = materialize(join_hot(families, parts, "family", "n", hot(parts)).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int")).drop("n"), "placed")
    task = ["cid", "rep", "set_key", "sig", "family", "part"]
    first, large = placed.select(*task, F.lit(0).alias("other"), F.col("cid").alias("label")), materialize(placed.where("parts > 1"), "large")
    some = not large.isEmpty()
    if some:  # the class that shares most keys with others goes to all parts
        degree = met.join(large.select("cid", "family"), "cid").groupBy("family", "cid").agg(F.sum("n").alias("d"))
        lead = materialize(degree.groupBy("family").agg(F.max_by("cid", F.struct("d", "cid")).alias("first")), "leads")
        most = large.join(lead, F.col("cid") == F.col("first")).drop(lead["family"])
        copies = most.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        first = first.join(lead.select(F.col("first").alias("cid")), "cid", "left_anti").select(*first.columns).union(copies.select(*task, F.lit(0), "cid"))
    links = materialize(_linked(docs, first, k, percent), "links")
    if some:
        found = materialize(components(links), "found")
        united = large.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        united = materialize(united.join(lead, "family"), "united")
        main = united.where("cid = first").select(F.col("family").alias("family_"), F.col("component").alias("main"))
        united = united.join(main, F.col("family") == F.col("family_"))
        apart = united.where("component != main")
        rest = materialize(apart.groupBy("family").agg(F.ceil(F.sum("n_shingles") / family).cast("int").alias("others")), "others")
        # A row of the main set meets the parts of those apart; each of those meets all parts, and the parts of those apart.
        slots = F.sequence(F.lit(0), F.col("others") - 1)
        kept = united.where("component = main").join(rest, "family").withColumn("other", F.explode(slots))
        apart = apart.join(rest, "family").withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), "others").cast("int"))
        every = apart.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("other", F.col("own"))
        among = apart.withColumn("with", F.explode(slots)).withColumn("part", -1 - F.greatest("own", "with")).withColumn("other", F.least("own", "with"))
        second = [x.select(*task, "other", F.col("component").alias("label")) for x in (kept, every, among)]
        second = second[0].union(second[1]).union(second[2])
        links = links.union(materialize(_linked(docs, second, k, percent), "links"))
    # Classes of one doc_id are one node, as texts of it are.
    holders = known.join(classes.select("set_key", "cid"), "set_key").select("doc_id", "cid")
    several = materialize(holders.groupBy("doc_id").agg(F.min("cid").alias("src"), F.max("cid").alias("last"), F.count("*").alias("n")).where("src < last").drop("last"), "several")
    same = join_hot(holders, several, "doc_id", "n", hot(several)).select("src", F.col("cid").alias("dst"))
    groups = components(links.union(same))
    named = classes.join(groups, F.col("cid") == F.col("id"), "left").select(F.col("set_key").alias("key_"), F.coalesce("component", "cid").alias("group"), "rep")
    named = materialize(named, "named")
    least = materialize(named.groupBy("group").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "least")
    named = join_hot(named, least, "group", "n", hot(least)).select("key_", "component")
    return features.join(named, F.col("doc_id").isNotNull() & (F.col("set_key") == F.col("key_")), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.coalesce("component", "doc_id") == F.col("doc_id")).alias("kept")
    )


def _linked(docs: DataFrame, tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """tasks(cid, rep, set_key, sig, family, part, other, label) -> links (src, dst) among the classes of each (family, part, other)."""
    return only_ids(docs, tasks.select("rep")).join(tasks, F.col("doc_id") == F.col("rep")).drop("doc_id", "rep").groupBy("family", "part", "other").applyInArrow(_compare(k, percent), "src long, dst long")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; rows with a null doc_id stay. Columns as they were.

    All rows of a doc_id are kept or go together.
    """
    return without_ids(docs, near_duplicates(docs, k, percent).where("NOT kept").select("doc_id"))

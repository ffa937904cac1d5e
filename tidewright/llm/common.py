"""What the operators of this subpackage share: scratch tables, words and their hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this process under the shared spark.checkpoint.dir (a local one only in a local session that has none)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidewright-checkpoints"
    if base not in _ROOTS:
        _ROOTS[base] = f"{base.rstrip('/')}/tidewright-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[base])
    return _ROOTS[base]


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder goes with the checkpoints
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files of a bucketed table at most (Spark allows 100,000); more blocks than that share files.
MOST_FILES = 50_000


def materialize_by_block(df: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    """Like materialize, bucketed by key into a file for each block or a few, so that later groupings by key need no shuffle.

    The table is known to the catalog only while it is being opened; its files stay in the scratch folder.
    """
    spark, files = df.sparkSession, min(blocks, MOST_FILES)
    path, t = scratch_path(spark, name), f"tw_{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(files, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(files, key).sortBy(key).saveAsTable(t))
    opened = spark.table(t)
    spark.sql(f"DROP TABLE {t}")  # external: its files remain
    return opened


#: Rows of a checked table that may be broadcast: ids or keys with a number or two, some tens of MB.
MOST_BROADCAST = 1_000_000


def fresh(name: str, columns: list[str]) -> str:
    """name, with as many underscores as it needs to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows whose id is not in ids (one column). Ids are counted first: a bounded number is broadcast and rows stay where they are."""
    name = fresh("gone", rows.columns)
    ids = materialize(ids.toDF(name).distinct(), "gone")
    few = ids.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(ids) if few else ids, rows[column] == F.col(name), "left_anti")


def only_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows whose id is in ids (one column), where those are few enough to be broadcast; else all rows, for a join to sort out."""
    name = fresh("wanted", rows.columns)
    ids = materialize(ids.toDF(name).distinct(), "wanted")
    return rows.join(F.broadcast(ids), rows[column] == F.col(name), "left_semi") if ids.count() <= MOST_BROADCAST else rows


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, hot: int) -> DataFrame:
    """rows joined with facts (one row a key; n: how many rows have it). Keys of more than hot rows are broadcast, so that
    none of them fills a task; there are at most count / hot of those. facts should be materialized, as it is read twice."""
    if facts.where(F.col(n) > hot).isEmpty():
        return rows.join(facts, key)
    named = F.broadcast(facts.where(F.col(n) > hot).select(key))
    columns = [*rows.columns, *[c for c in facts.columns if c != key]]
    often = rows.join(F.broadcast(facts.where(F.col(n) > hot)), key).select(*columns)
    return often.union(rows.join(named, key, "left_anti").join(facts.where(F.col(n) <= hot), key).select(*columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_block(df: DataFrame, blocks: int, key: str = "doc_id") -> DataFrame:
    """Adds the column block, from 0 to blocks - 1, a function of the key alone."""
    return df.withColumn("block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int"))


#: What Python workers keep between batches, by the operator that uses it.
_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    return _KEPT.setdefault(name, {})


def only(name: str) -> None:
    """Called where a task begins: a reused worker lets go of what other operators kept, so their memos don't add up; what
    batches took goes back to the system, not to a pool of the worker's."""
    pa.set_memory_pool(pa.system_memory_pool())
    others = [d for n, d in _KEPT.items() if n != name and d]
    for d in others:
        d.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


#: Distinct words whose hashes a Python worker keeps; beyond it the memo starts anew (speed only, never results).
MEMO = 300_000


class WordHashes(dict):
    """word (UTF-8 bytes) -> unsigned 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _KEPT["words"] = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space ([^\\x20\\x09-\\x0D]+), as UTF-8; null: none. lower: A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def _odd_powers(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit multiply-xorshift hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_COEFFICIENTS = _odd_powers(1024, 20_011)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for j in range(k):
        out += h[j : j + n] * _COEFFICIENTS[j]
    return mix(out)

"""Sources by name: each turns its settings into one bounded scan, and a read request into a projection and filters of it.

Databases, streams and lake tables are Spark's own formats, whose packages a cluster brings; here their settings are checked and made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ReadRequest, quote_identifier, read_records, require_read_only_select, write_records
from .records import in_chunks, read_sqlite


def jdbc_options(url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, fetch: int = 10_000) -> dict[str, str]:
    """Options of a read-only scan; key and bounds deal it to parts tasks."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC address begins with jdbc:")
    out = {"url": url, "dbtable": f"({require_read_only_select(query)}) AS q", "fetchsize": str(fetch)}
    if parts > 1:
        if key is None or bounds is None or bounds[0] >= bounds[1]:
            raise ValueError("several parts need a key column and its bounds")
        out |= {"partitionColumn": quote_identifier(key).strip("`"), "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return out


def kafka_options(servers: str, topic: str, start: str = "earliest", end: str = "latest") -> dict[str, str]:
    """Options of a capture that ends: a scan of a topic from one set of offsets to another."""
    if not servers or not topic or "," in topic or "*" in topic:
        raise ValueError("servers and one topic")
    if end == "earliest" or start == "latest":
        raise ValueError("a capture runs from earlier to later offsets")
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "endingOffsets": end, "failOnDataLoss": "true"}


def partition_filter(values: dict[str, object]):
    """Equality on partition columns, nulls included, as one condition that prunes files."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name).isNull() if value is None else F.col(name) == value)
    return out


@dataclass
class Sources:
    """Readers by kind; each takes the session and settings and gives a frame."""

    readers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, kind: str, reader: Callable[..., DataFrame]) -> None:
        if kind in self.readers:
            raise ValueError(f"{kind} is there already")
        self.readers[kind] = reader

    def scan(self, spark: SparkSession, kind: str, request: ReadRequest | None = None, **settings) -> DataFrame:
        if kind not in self.readers:
            raise ValueError(f"no source {kind!r}; there are {sorted(self.readers)}")
        return (request or ReadRequest()).apply(self.readers[kind](spark, **settings))

    def batches(self, spark: SparkSession, kind: str, size: int, request: ReadRequest | None = None, **settings) -> Iterator[list]:
        """The scan's rows in lists of size, on the driver, one partition at a time."""
        return in_chunks(self.scan(spark, kind, request, **settings), size)

    def inspect(self, spark: SparkSession, kind: str, **settings) -> list[tuple[str, str]]:
        return self.scan(spark, kind, **settings).dtypes

    def healthy(self, spark: SparkSession, kind: str, **settings) -> bool:
        """Whether a scan gives its first row, or says that it has none."""
        try:
            self.scan(spark, kind, ReadRequest(limit=1), **settings).collect()
        except Exception:  # noqa: BLE001  (any failure of a source is what is asked for)
            return False
        return True


def sources() -> Sources:
    out = Sources()
    for kind in ("csv", "tsv", "jsonl", "json", "parquet", "orc", "arrow"):
        out.register(kind, lambda spark, path, kind=kind: read_records(spark, path, kind))
    out.register("sqlite", read_sqlite)
    out.register("jdbc", lambda spark, **s: spark.read.format("jdbc").options(**jdbc_options(**s)).load())
    out.register("kafka", lambda spark, **s: spark.read.format("kafka").options(**kafka_options(**s)).load())
    out.register("delta", lambda spark, path, version=None: spark.read.format("delta").options(**({} if version is None else {"versionAsOf": version})).load(path))
    out.register("iceberg", lambda spark, table, snapshot=None: spark.read.format("iceberg").options(**({} if snapshot is None else {"snapshot-id": snapshot})).load(table))
    return out


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files as they are, read by tasks."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def replace_atomically(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes beside path and takes its place by renames; a reader sees the old rows or the new ones, or for a moment none."""
    spark = df.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)  # noqa: E731, SLF001
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    write_records(df, new, kind, "replace")
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    files.delete(at(old), True)
    if files.exists(at(path)) and not files.rename(at(path), at(old)):
        raise OSError(f"{path} could not be moved away")
    if not files.rename(at(new), at(path)):
        raise OSError(f"{new} could not take the place of {path}")
    files.delete(at(old), True)

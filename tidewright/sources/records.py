"""Records of any schema: checks, fingerprints, partitions, pages, odd number and time formats, and databases that Python can open."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import require_read_only_select


@dataclass(frozen=True)
class FieldRule:
    name: str
    kind: str  # a Spark SQL type
    required: bool = True


def validate_records(df: DataFrame, rules: list[FieldRule], row: str, most_issues: int = 100) -> tuple[DataFrame, DataFrame]:
    """(issues(row, field, issue) by row, at most most_issues: a report; missing(field, n) over all rows). row: a column that names each.

    Strings are tried as the type that a rule asks for; a column without a rule is an issue of its own, with no row.
    """
    known, checks = {r.name for r in rules}, []
    for r in rules:
        if r.name not in df.columns:
            bad = F.when(F.lit(r.required), "no such column")
        else:
            c = F.col(r.name)
            bad = F.when(c.isNull() & F.lit(r.required), "missing").when(c.isNotNull() & c.cast("string").try_cast(r.kind).isNull(), f"not {r.kind}")
        checks.append(F.struct(F.lit(r.name).alias("field"), bad.alias("issue")))
    found = df.select(F.col(row).cast("string").alias("row"), F.explode(F.array(*checks)).alias("c")).select("row", "c.*").where("issue IS NOT NULL")
    extra = [(None, c, "no rule") for c in df.columns if c not in known and c != row]
    issues = found.union(df.sparkSession.createDataFrame(extra, "row string, field string, issue string")) if extra else found
    counts = df.agg(*[F.count_if(F.col(r.name).isNull()).alias(r.name) for r in rules if r.name in df.columns])
    missing = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in counts.columns])).alias("m")).select("m.*")
    return issues.orderBy("row", "field").limit(most_issues), missing


def fingerprint_records(df: DataFrame, order: list[str]) -> DataFrame:
    """(rows, sha256): one digest of all rows' canonical JSON, in order, as a tree: rows in groups of 1024, groups in groups, to one.

    Columns go in by name, so their order does not matter; that of rows does. No task holds more than a group.
    """
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    ranged = df.select(F.struct(*order).alias("o_"), F.sha2(text, 256).alias("h_")).withColumn("b_", F.pmod(F.xxhash64("h_"), F.lit(1 << 20)))
    # The multiset of rows decides, told apart by their order columns: buckets of like hashes, sorted, hashed.
    one = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: F.concat_ws(" ", F.to_json(x["o_"]), x["h_"])), "\n"), 256)
    level = ranged.groupBy("b_").agg(F.count("*").alias("n_"), one(F.struct("o_", "h_")).alias("h_"))
    for _ in range(2):
        up = level.select(F.shiftright("b_", 10).alias("b_"), "n_", F.struct(F.struct(F.col("b_").alias("b")).alias("o_"), "h_").alias("r_"))
        level = up.groupBy("b_").agg(F.sum("n_").alias("n_"), one(F.col("r_")).alias("h_"))
    return level.select(F.col("n_").alias("rows"), F.col("h_").alias("sha256"))


def plan_row_partitions(spark: SparkSession, total: int, size: int) -> DataFrame:
    """(partition, start, stop): [0, total) in ranges of size rows, the last one shorter."""
    if total < 0 or size < 1:
        raise ValueError("a total of 0 or more, and a size of 1 or more")
    return spark.range(-(-total // size)).select(F.col("id").alias("partition"), (F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(total)).cast("long").alias("stop"))


def plan_time_partitions(spark: SparkSession, start: datetime, stop: datetime, interval: timedelta) -> DataFrame:
    """(partition, start, stop): half-open slices of [start, stop), the last one cut; times in microseconds since 1970, UTC."""
    if start.tzinfo is None or stop.tzinfo is None or stop <= start or interval <= timedelta(0):
        raise ValueError("times with a zone, in order, and a positive interval")
    a, b, step = round(start.timestamp() * 1e6), round(stop.timestamp() * 1e6), interval // timedelta(microseconds=1)
    return spark.range(-(-(b - a) // step)).select(F.col("id").alias("partition"), (a + F.col("id") * step).alias("start"), F.least(a + (F.col("id") + 1) * step, F.lit(b)).cast("long").alias("stop"))


def page(df: DataFrame, key: str, after: int | str | None, size: int) -> DataFrame:
    """The next size rows by key after a cursor, which is the last key seen; a filter that reaches the files, no offset."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def in_chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of size, one partition at a time on the driver."""
    part: list = []
    for row in df.toLocalIterator():
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def number(text: Column, decimal: str = ".", thousands: str | None = None) -> Column:
    """A number in a locale's writing; empty text is null, and what is no number fails."""
    t = F.trim(text)
    if thousands:
        t = F.replace(t, F.lit(thousands), F.lit(""))
    if decimal != ".":
        t = F.replace(t, F.lit(decimal), F.lit("."))
    return F.when(t == "", None).otherwise(t.cast("double"))


def utc_timestamp(text: Column) -> Column:
    """Microseconds since 1970 of seconds since then or of ISO 8601 with a zone; a time without a zone fails."""
    seconds = text.try_cast("double")
    zoned = text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.when(zoned, F.unix_micros(F.to_timestamp(text))).otherwise(F.raise_error(F.concat(F.lit("no zone: "), text)).cast("long"))
    return F.when(text.isNull(), None).when(seconds.isNotNull(), F.round(seconds * 1_000_000).cast("long")).otherwise(iso)


def inspect_parquet(path: str) -> dict:
    """Rows, row groups and fields of a file, from its footer alone."""
    f = pq.ParquetFile(path)
    return {"rows": f.metadata.num_rows, "row_groups": f.metadata.num_row_groups, "fields": [(x.name, str(x.type)) for x in f.schema_arrow]}


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, parameters: tuple = (), key: str | None = None, parts: int = 1) -> DataFrame:
    """Rows of a read-only SELECT, read by tasks; key (an integer column of the result) and parts deal it to several by remainder.

    The file must lie where executors can open it. Rows go on as Arrow batches, so none is held whole.
    """
    body = require_read_only_select(query)
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    text = body if key is None else f'SELECT * FROM ({body}) WHERE abs("{key}") % {int(parts)} = {int(k)}'
                    cursor = db.execute(text, parameters)
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return spark.range(parts if key else 1, numPartitions=parts if key else 1).mapInArrow(run, schema)


def band_table(bands: DataFrame, states: list[str], time: str = "t") -> DataFrame:
    """bands(t, state, lower, median, upper) -> time and <state>_lower, _median, _upper, a column for each: what a band file holds."""
    pick = lambda s, k: F.max(F.when(F.col("state") == s, F.col(k))).alias(f"{s}_{k}")
    return bands.groupBy(F.col(time).alias("time")).agg(*[pick(s, k) for s in states for k in ("lower", "median", "upper")])


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """accuracy: the share of rows whose labels are equal."""
    return df.agg(F.avg(F.col(left).eqNullSafe(F.col(right)).cast("int")).alias("accuracy"))


def interval_coverage(df: DataFrame, value: str, low: str, high: str) -> DataFrame:
    return df.agg(F.avg(F.col(value).between(F.col(low), F.col(high)).cast("int")).alias("coverage"))


def compare_keys(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, removed, changed or same, by a full outer join of two runs' values."""
    a, b = left.select(F.col(key).alias("a_"), F.col(value).alias("x_")), right.select(F.col(key).alias("b_"), F.col(value).alias("y_"))
    joined = a.join(b, F.col("a_") == F.col("b_"), "full")
    status = F.when(F.col("a_").isNull(), "added").when(F.col("b_").isNull(), "removed").when(F.col("x_").eqNullSafe(F.col("y_")), "same").otherwise("changed")
    return joined.select(F.coalesce("a_", "b_").alias(key), status.alias("status"))


def usage(df: DataFrame, tenant: str, action: str, amount: str) -> DataFrame:
    return df.groupBy(tenant, action).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))

"""Reading and writing: numeric files as series frames, records as they are, requests as projections and filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import IDENTIFIER, KEY, TIME

#: Statements that write or change the session, where a statement may begin: at the start, beside a bracket; and a SELECT's INTO.
_WRITES = re.compile(r"(?:^|[()])\s*(?:insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|replace|copy|attach|detach|load|install|set|call|exec|execute|vacuum|pragma)\b(?!\s*\()|\binto\b", re.IGNORECASE)


def _numeric(df: DataFrame, time: str, series: str | None) -> DataFrame:
    names = [c.strip().lstrip("﻿") for c in df.columns]
    df = df.toDF(*names)
    if time not in names or any(not IDENTIFIER.fullmatch(c) for c in names):
        raise ValueError("the time column is missing or a header is no identifier")
    key = F.col(series).cast("string") if series else F.lit("series")
    return df.select(key.alias(KEY), F.col(time).cast("double").alias(TIME), *[F.col(c).cast("double").alias(c) for c in sorted(names) if c not in (time, series)])


def read_delimited(spark: SparkSession, path: str, time: str, delimiter: str = ",", series: str | None = None) -> DataFrame:
    """A numeric file with a header; a cell that is no number, or a row of other length, fails the read."""
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError("the delimiter must be one character, not a quote or a line break")
    header = spark.read.csv(path, sep=delimiter, header=True)
    schema = T.StructType([T.StructField(c, T.StringType() if c.strip() == series else T.DoubleType()) for c in header.columns])
    return _numeric(spark.read.csv(path, sep=delimiter, header=True, schema=schema, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True), time, series)


def read_parquet(spark: SparkSession, path: str, time: str, series: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    odd = [f.name for f in df.schema if f.name != series and not isinstance(f.dataType, T.NumericType)]
    if odd:
        raise ValueError(f"not numeric: {odd}")
    return _numeric(df, time, series)


def read_frame(spark: SparkSession, path: str, time: str, series: str | None = None) -> DataFrame:
    """By the file's suffix: .csv, .tsv, .parquet, .parq."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in (".csv", ".tsv"):
        return read_delimited(spark, path, time, "," if suffix == ".csv" else "\t", series)
    if suffix in (".parquet", ".parq"):
        return read_parquet(spark, path, time, series)
    raise ValueError(f"no reader for {suffix!r}")


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """csv and tsv as strings, jsonl, json (an array, one object, or an object whose records are the rows), parquet, orc, arrow."""
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t")
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path, mode="FAILFAST")
    if kind == "json":
        df = spark.read.json(path, multiLine=True, mode="FAILFAST")
        return df.selectExpr("inline(records)") if df.columns == ["records"] else df
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind in ("arrow", "feather", "ipc"):
        import pyarrow.feather as feather

        return spark.createDataFrame(feather.read_table(path))
    raise ValueError(f"no reader for {kind!r}")


def quote_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))


def require_read_only_select(query: str) -> str:
    """One SELECT or WITH statement in which no statement that writes begins; without its comments."""
    parts = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/"
    q = re.sub(parts, lambda m: m[0] if m[0][0] in "'\"" else " ", query, flags=re.DOTALL).strip().rstrip(";").strip()
    bare = re.sub(parts, " ", q, flags=re.DOTALL)
    if ";" in bare or not re.match(r"(?i)\s*(select|with)\b", bare) or _WRITES.search(bare):
        raise ValueError("only one read-only SELECT is allowed")
    return q


@dataclass(frozen=True)
class ReadRequest:
    """A scan: projection, equality filters, limit and offset. Catalyst takes the first two to the files."""

    columns: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    limit: int | None = None
    offset: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in (*self.columns, *self.filters) if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")
        for c, v in self.filters.items():
            df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
        df = df.select(*self.columns) if self.columns else df
        df = df.offset(self.offset) if self.offset else df
        return df if self.limit is None else df.limit(self.limit)


def write_records(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    modes = {"append": "append", "replace": "overwrite", "error": "errorifexists"}
    w = df.write.mode(modes[mode]).partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        w.csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind == "jsonl":
        w.json(path)
    else:
        w.format(kind).save(path)

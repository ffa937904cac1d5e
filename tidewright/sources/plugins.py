"""Functions from outside as table functions: what they say of themselves, what they may do, and a check of what they give back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import utc_timestamp

#: What a function may be granted; it has none of these unless its host allows it.
CAPABILITIES = {"read_data", "write_data", "network", "subprocess", "environment", "clock", "random", "artifacts", "simulate", "score"}


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    schema: str  # of the rows that it gives
    needs: frozenset[str] = frozenset()
    most_rows: int = 1_000_000  # a batch


@dataclass
class Registry:
    """Functions by name. What needs more than the host allows is not taken."""

    allowed: frozenset[str] = frozenset()
    held: dict[str, tuple[Manifest, Callable]] = field(default_factory=dict)

    def register(self, manifest: Manifest, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9-]*", manifest.name) or not re.fullmatch(r"\d+\.\d+\.\d+", manifest.version):
            raise ValueError("a name in lower case and a version of three numbers")
        if manifest.name in self.held:
            raise ValueError(f"{manifest.name} is there already")
        if odd := manifest.needs - CAPABILITIES:
            raise ValueError(f"no such capabilities: {sorted(odd)}")
        if more := manifest.needs - self.allowed:
            raise PermissionError(f"{manifest.name} needs {sorted(more)}, which the host does not allow")
        self.held[manifest.name] = (manifest, function)

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """The function over the batches of a frame; each batch that it gives is checked before it goes on."""
        manifest, function = self.held[name]
        fields = [(f.name, f.nullable) for f in df.sparkSession.createDataFrame([], manifest.schema).schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = function(batch)
                check_batch(out, fields, manifest.most_rows)
                yield out

        return df.mapInArrow(run, manifest.schema)


def check_batch(batch: pa.RecordBatch, fields: list[tuple[str, bool]], most_rows: int) -> int:
    """The rows of a batch that has the fields, in order, no more rows than allowed, and nulls only where they may be."""
    if batch.schema.names != [n for n, _ in fields]:
        raise ValueError(f"columns {batch.schema.names} instead of {[n for n, _ in fields]}")
    if batch.num_rows > most_rows:
        raise ValueError(f"{batch.num_rows} rows, of {most_rows} allowed")
    for name, nullable in fields:
        if not nullable and batch.column(name).null_count:
            raise ValueError(f"{name} has nulls")
    return batch.num_rows


def daily_prices(df: DataFrame, names: dict[str, str], checked: bool = True) -> DataFrame:
    """(us, open, high, low, close, volume) from columns of other names; times with a zone, in microseconds UTC.

    checked: raises for a row whose high is below, or low above, its other prices, or whose volume is negative.
    """
    price = lambda k: F.col(names.get(k, k)).cast("double").alias(k)
    rows = df.select(utc_timestamp(F.col(names.get("time", "time")).cast("string")).alias("us"), *[price(k) for k in ("open", "high", "low", "close", "volume")])
    good = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close")) & (F.col("volume") >= 0)
    return rows.withColumn("close", F.when(good, F.col("close")).otherwise(F.raise_error(F.lit("prices that cannot be")).cast("double"))) if checked else rows


def report(title: str, sections: dict[str, object], kind: str = "markdown") -> str:
    """A report of named sections (text, numbers, mappings, lists of mappings as tables), as Markdown or JSON."""
    if kind == "json":
        return json.dumps({"title": title, "sections": sections}, sort_keys=True, indent=2)
    if kind != "markdown":
        raise ValueError(f"no such report: {kind!r}")
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}"]
    for name, body in sections.items():
        out.append(f"## {name}")
        if isinstance(body, list) and body and isinstance(body[0], dict):
            heads = list(dict.fromkeys(k for r in body for k in r))
            out += ["| " + " | ".join(map(cell, heads)) + " |", "|" + "-|" * len(heads), *["| " + " | ".join(cell(r.get(h, "")) for h in heads) + " |" for r in body]]
        elif isinstance(body, dict):
            out += [f"- {k}: {v}" for k, v in body.items()]
        else:
            out.append(str(body))
    return "\n".join(out) + "\n"

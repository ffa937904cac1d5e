"""Events of series: crossings, schedules and laws by regime."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours


def crossing(before: Column, now: Column, direction: str = "any") -> Column:
    """Whether two successive values cross zero. One that begins at zero does not cross it again; values that are not finite never do."""
    rising, falling = (before < 0) & (now >= 0), (before > 0) & (now <= 0)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite(before) & finite(now) & {"any": rising | falling, "rising": rising, "falling": falling}[direction]


def crossings(df: DataFrame, column: str, level: float = 0.0, direction: str = "any") -> DataFrame:
    """(series_id, t, crossed_at): rows at which column crosses level, and where the line between the two rows meets it."""
    rows = neighbours(df.select(KEY, TIME, column), [column])
    a, b = F.col(f"prev_{column}") - level, F.col(column) - level
    at = F.col(f"prev_{TIME}") + (F.col(TIME) - F.col(f"prev_{TIME}")) * a / (a - b)
    return rows.where(crossing(a, b, direction)).select(KEY, TIME, at.alias("crossed_at"))


def split_at_events(spans: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """spans(keys, start, end), events(keys, time) -> (keys, start, end): each span cut at its events' distinct times.

    Raises where an event lies outside its span or a span is empty. One row a cut, so events are grouped, not collected.
    """
    bad = F.raise_error(F.lit("an event outside its span, or an empty span"))
    ends = spans.select(*keys, F.when(F.col("end") > F.col("start"), F.col("start")).otherwise(bad.cast("double")).alias("start"), "end")
    inside = events.join(ends, keys).select(*keys, F.when(F.col("time").between(F.col("start"), F.col("end")), F.col("time")).otherwise(bad.cast("double")).alias("time"))
    cuts = ends.select(*keys, F.col("start").alias("time")).union(ends.select(*keys, "end")).union(inside).distinct()
    rows = neighbours(cuts.select(F.to_json(F.struct(*keys)).alias(KEY), F.struct(*keys).alias("k_"), F.col("time").alias(TIME)), [])
    return rows.where(F.col(f"next_{TIME}").isNotNull()).select("k_.*", F.col(TIME).alias("start"), F.col(f"next_{TIME}").alias("end"))


def next_change(df: DataFrame, changes: list[float], end: float) -> DataFrame:
    """df with next_change: the first scheduled time after t and before end. The schedule is a literal, so no join."""
    known = sorted({float(c) for c in changes if math.isfinite(c) and c < end})
    later = F.filter(F.array(*[F.lit(c) for c in known]) if known else F.array().cast("array<double>"), lambda c: c > F.col(TIME))
    return df.withColumn("next_change", F.array_min(later))


def laws_by_regime(df: DataFrame, laws: dict[int, tuple[float, float]], regime: str, column: str) -> DataFrame:
    """df with law: intercept + slope * column of the row's regime; raises for a regime without a law."""
    if any(not math.isfinite(v) for law in laws.values() for v in law):
        raise ValueError("laws have finite intercepts and slopes")
    out = F.raise_error(F.concat(F.lit("no law for regime "), F.col(regime).cast("string"))).cast("double")
    for k, (intercept, slope) in laws.items():
        out = F.when(F.col(regime) == k, intercept + slope * F.col(column)).otherwise(out)
    return df.withColumn("law", out)


def sampled_control(df: DataFrame, times: list[float], values: list[float], name: str) -> DataFrame:
    """df with a control that is sampled at a few times, on straight lines between them and held beyond them."""
    if not times or len(times) != len(values) or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("a control needs values at strictly ascending times")
    out = F.lit(float(values[-1]))
    for a, b, u, v in reversed(list(zip(times, times[1:], values, values[1:], strict=False))):
        out = F.when(F.col(TIME) < b, u + (v - u) * (F.col(TIME) - a) / (b - a)).otherwise(out)
    return df.withColumn(name, F.when(F.col(TIME) <= times[0], float(values[0])).otherwise(out))

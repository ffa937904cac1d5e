"""Ordered logs of events by scope: numbers, reading on after one, what is kept, what breaks the order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours, numbered


def sequenced(events: DataFrame, scope: str, at: str, first: int = 1) -> DataFrame:
    """events with sequence: the number of each in its scope, in order of at, which must not tie."""
    rows = events.withColumn(KEY, F.col(scope).cast("string")).withColumn(TIME, F.col(at))
    return numbered(rows, "rn_").withColumn("sequence", F.col("rn_") + first).drop("rn_", KEY, TIME)


def events_after(events: DataFrame, scope: str, value, after: int) -> DataFrame:
    """The events of one scope after a number, in order: what a reader that has seen so many goes on with."""
    return events.where((F.col(scope) == value) & (F.col("sequence") > after)).orderBy("sequence")


def retained(events: DataFrame, scope: str, most: int) -> DataFrame:
    """The last most events of each scope, by its largest number: an aggregate and a join, no sort."""
    last = events.groupBy(scope).agg(F.max("sequence").alias("last_"))
    return events.join(last, scope).where(F.col("sequence") > F.col("last_") - most).drop("last_")


def out_of_order(events: DataFrame, scope: str, at: str) -> DataFrame:
    """(scope, at, sequence, before): events whose number is not above that of the event before them in time."""
    rows = events.select(F.col(scope).cast("string").alias(KEY), F.col(at).alias(TIME), "sequence")
    bad = neighbours(rows, ["sequence"]).where("sequence <= prev_sequence")
    return bad.select(F.col(KEY).alias(scope), F.col(TIME).alias(at), "sequence", F.col("prev_sequence").alias("before"))

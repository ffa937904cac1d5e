"""Series frames: (series_id string, t double, value columns double), and the driver tables as such."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.window import WindowSpec

from .scratch import written
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[A-Za-z_-][A-Za-z0-9_-]*")
KEY, TIME = "series_id", "t"
#: Rows that a chunk of one long series should hold; windows over a chunk are one task's sort.
CHUNK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (KEY, TIME)]


def series_window(ties: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy(KEY).orderBy(TIME, *ties)


def rebase(df: DataFrame, micros: Column, *columns: Column) -> DataFrame:
    """t in seconds since the first row of each series. The minima are one row a series, joined, not a window over all rows."""
    raw = df.select(F.col(KEY), micros.alias("us_"), *columns)
    start = raw.groupBy(KEY).agg(F.min("us_").alias("start_"))
    rest = [c for c in raw.columns if c not in (KEY, "us_")]
    return raw.join(start, KEY).select(KEY, ((F.col("us_") - F.col("start_")) / 1e6).alias(TIME), *rest)


def events_frame(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One series per event type: t seconds since its first event, x the value; and more columns of events."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", KEY)
    return rebase(e, F.unix_micros(F.col("ts").cast("timestamp")), F.col("value").alias("x"), *map(F.col, more))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: t days since the first order, x millions ordered, y orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 1e6).alias("x"), F.count("*").cast("double").alias("y"))
    first = o.agg(F.min("d").alias("first_"))
    return o.crossJoin(F.broadcast(first)).select(F.lit("orders").alias(KEY), F.datediff("d", "first_").cast("double").alias(TIME), "x", "y")  # first_ is one row


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression rows: q quantity / 50, d discount, x tax, y price / 1e5."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))


#: Chunks of a series at most; a longer one has longer chunks.
MOST_CHUNKS = 10_000


def largest_series(df: DataFrame) -> int:
    return df.groupBy(KEY).count().agg(F.max("count")).first()[0] or 0


def chunked(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """df with chunk_, in order of t within each series: stretches of about chunk_rows rows, however t is spread. Written once, as it is read often.

    The cuts are ranks of t, from one sketch of bounded size a series, so a burst is many chunks; only rows at one instant cannot be
    parted. Series that need cuts are at most rows / chunk_rows. A row's chunk is the number of cuts below it, found in two steps.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    most = min(MOST_CHUNKS, -(-largest_series(df) // chunk_rows))
    if most < 2:
        return df.withColumn("chunk_", F.lit(0))
    step = math.ceil(math.sqrt(most))
    cuts = F.percentile_approx(TIME, F.lit([k / most for k in range(1, most)]), max(10_000, 20 * most))
    found = df.groupBy(KEY).agg(F.count("*").alias("n_"), cuts.alias("cuts_")).where(F.col("n_") > chunk_rows).select(KEY, "cuts_")
    found = found.withColumn("coarse_", F.filter("cuts_", lambda c, i: (i + 1) % step == 0))
    below = lambda cs: F.size(F.filter(cs, lambda c: c < F.col(TIME)))
    joined = df.join(F.broadcast(found), KEY, "left").withColumn("full_", F.coalesce(below(F.col("coarse_")), F.lit(0)) * step)
    inside = below(F.slice("cuts_", F.col("full_") + 1, step))
    chunk = F.when(F.col("cuts_").isNull(), 0).otherwise(F.col("full_") + inside)
    return written(joined.select(*df.columns, chunk.cast("long").alias("chunk_")), "chunks")


def numbered(df: DataFrame, name: str = "rn_", chunk_rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the number of each row, from 0, in order of t within its series (of ties, where rows share t). Long series are numbered in chunks, whose counts give their first numbers."""
    chunk_rows = chunk_rows or CHUNK_ROWS
    if largest_series(df) <= chunk_rows:
        return df.withColumn(name, F.row_number().over(series_window(ties)).cast("long") - 1)
    cut = chunked(df, chunk_rows)
    counts = cut.groupBy(KEY, "chunk_").agg(F.count("*").alias("n_"))
    first = counts.select(KEY, "chunk_", (F.sum("n_").over(Window.partitionBy(KEY).orderBy("chunk_")) - F.col("n_")).alias("first_"))  # one row a chunk
    inside = F.row_number().over(Window.partitionBy(KEY, "chunk_").orderBy(TIME, *ties))
    return cut.withColumn("in_", inside).join(first, [KEY, "chunk_"]).select(*df.columns, (F.col("first_") + F.col("in_") - 1).alias(name))


def running_sum(df: DataFrame, column: str, name: str, chunk_rows: int | None = None) -> DataFrame:
    """df with rn_, the number of each row in its series, and the sum of column over the rows before it."""
    rows = numbered(df, "rn_", chunk_rows)
    size = chunk_rows or CHUNK_ROWS
    rows = rows.withColumn("block_", F.floor(F.col("rn_") / size))
    sums = rows.groupBy(KEY, "block_").agg(F.sum(column).alias("b_"))
    before = sums.select(KEY, "block_", F.sum("b_").over(Window.partitionBy(KEY).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)).alias("a_"))  # one row a block
    inside = F.sum(column).over(Window.partitionBy(KEY, "block_").orderBy("rn_").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("s_in_", inside).join(before, [KEY, "block_"])
    return out.select(*df.columns, "rn_", (F.coalesce("a_", F.lit(0.0)) + F.coalesce("s_in_", F.lit(0.0))).alias(name))


def within_rows(df: DataFrame, before: int, after: int, add: Callable[[DataFrame, WindowSpec], DataFrame], chunk_rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """add(rows, window) where the window looks at most before rows back and after rows ahead; ties are columns that order rows at one instant.

    Series of at most chunk_rows rows are one window each. Longer ones are cut into blocks of so many rows; the rows at a block's borders go
    to its neighbours, too, and are left out of what those give back.
    """
    size = max(chunk_rows or CHUNK_ROWS, before + after, 1)
    if largest_series(df) <= size:
        return add(df, series_window(ties))
    rows = numbered(df, "rn_", size, ties)
    home = F.floor(F.col("rn_") / size)
    low, high = F.floor((F.col("rn_") - after) / size), F.floor((F.col("rn_") + before) / size)
    copies = rows.select("*", home.alias("home_"), F.explode(F.sequence(low, high)).alias("block_"))
    out = add(copies, Window.partitionBy(KEY, "block_").orderBy("rn_")).where("home_ = block_")
    return out.drop("rn_", "home_", "block_")


def nearest_known(df: DataFrame, value: Column, back: str | None, ahead: str | None, order: tuple[list[Column], list[Column]] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """df with the last non-null value at or before each row (column back) and the next at or after it (ahead), in order of t
    (order: how rows are ordered forwards and backwards, where t alone does not say).

    Both are running values of one sort, the next one of the order reversed. A long series is cut into chunks; what
    earlier and later chunks know last and first is one row a chunk.
    """
    up, down = order or ([F.col(TIME).asc()], [F.col(TIME).desc()])
    running = lambda keys, way: F.last("v_", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("v_", value)
    if largest_series(df) <= (chunk_rows or CHUNK_ROWS):
        for name, way in ((back, up), (ahead, down)):
            if name:
                rows = rows.withColumn(name, running([KEY], way))
        return rows.drop("v_")
    rows, keys = chunked(rows, chunk_rows), [KEY, "chunk_"]
    known = rows.where(F.col("v_").isNotNull()).groupBy(*keys).agg(F.max_by("v_", TIME).alias("last_"), F.min_by("v_", TIME).alias("first_"))
    along = rows.select(*keys).distinct().join(known, keys, "left")
    w = Window.partitionBy(KEY).orderBy("chunk_")  # one row a chunk
    v = Window.partitionBy(KEY).orderBy(F.desc("chunk_"))
    along = along.select(*keys, F.last("last_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"), F.last("first_", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("after_"))
    for name, way in ((back, up), (ahead, down)):
        if name:
            rows = rows.withColumn(name, running(keys, way))
    rows = rows.join(along, keys)
    for name, more in ((back, "before_"), (ahead, "after_")):
        if name:
            rows = rows.withColumn(name, F.coalesce(name, more))
    return rows.drop("v_", "chunk_", "before_", "after_")


def neighbours(df: DataFrame, columns: list[str], chunk_rows: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with prev_<c> and next_<c> of t and columns, in order of t (and ties) within each series."""
    names, row = [TIME, *columns], F.struct(TIME, *columns)

    def add(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("p_", F.lag(row).over(w)).withColumn("n_", F.lead(row).over(w))

    out = within_rows(df, 1, 1, add, chunk_rows, ties)
    return out.select(*df.columns, *[F.col("p_")[c].alias(f"prev_{c}") for c in names], *[F.col("n_")[c].alias(f"next_{c}") for c in names])


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 and DuckDB's SQL have it: by zero it is infinite or NaN, where Spark's own is an error (or null)."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def violations(df: DataFrame) -> DataFrame:
    """Rows that break the rules of a series frame: (series_id, t, problem). Empty for a valid frame."""
    values = value_columns(df)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    bad = F.when(F.col(KEY).isNull(), "null series").when(~finite(TIME), "time not finite")
    for c in values:
        bad = bad.when(~finite(c), f"{c} not finite")
    first = df.select(KEY, TIME, bad.alias("problem")).where("problem IS NOT NULL")
    twice = df.groupBy(KEY, TIME).count().where("count > 1").select(KEY, TIME, F.lit("time not strictly increasing").alias("problem"))
    return first.union(twice)


def validated(df: DataFrame) -> DataFrame:
    """The frame with its value columns sorted by name; raises where a name is no identifier or a row breaks the rules."""
    values = sorted(value_columns(df))
    if not values or any(not IDENTIFIER.fullmatch(c) for c in values):
        raise ValueError("a series frame needs value columns that are identifiers")
    if found := violations(df).head(1):
        raise ValueError(f"not a series frame: {found[0].asDict()}")
    return df.select(KEY, F.col(TIME).cast("double").alias(TIME), *[F.col(c).cast("double").alias(c) for c in values])

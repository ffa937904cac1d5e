"""Preparation of series: trimming, scaling, smoothing, filling, resampling, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, nearest_known, neighbours, numbered, value_columns, within_rows
from .profile import quantiles_by


def trim(df: DataFrame, start: float, end: float) -> DataFrame:
    return df.where(F.col(TIME).between(start, end))


def drop_constant(df: DataFrame) -> DataFrame:
    """Without the columns that have one value in the whole frame; one aggregate finds them."""
    values = value_columns(df)
    r = df.agg(*[F.min(c).alias(f"lo_{c}") for c in values], *[F.max(c).alias(f"hi_{c}") for c in values]).first()
    return df.select(KEY, TIME, *[c for c in values if r[f"lo_{c}"] != r[f"hi_{c}"]])


def standardize(df: DataFrame, column: str) -> DataFrame:
    """z-scores by the population deviation; the moments are one row a series."""
    m = df.groupBy(KEY).agg(F.avg(column).alias("mean_"), F.stddev_pop(column).alias("sd_"))
    z = F.when(F.col("sd_") > 0, (F.col(column) - F.col("mean_")) / F.col("sd_")).otherwise(F.raise_error(F.lit(f"{column} is constant")).cast("double"))
    return df.join(m, KEY).withColumn(f"z_{column}", z).drop("mean_", "sd_")


def unstandardize(df: DataFrame, column: str, mean: float, deviation: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * deviation + mean)


def detrend_linear(df: DataFrame, column: str) -> DataFrame:
    """Less the least-squares line on t, from sums centred on the means."""
    m = df.groupBy(KEY).agg(F.avg(TIME).alias("mt_"), F.avg(column).alias("mx_"))
    c = df.join(m, KEY)
    s = c.groupBy(KEY).agg((F.sum((F.col(TIME) - F.col("mt_")) * (F.col(column) - F.col("mx_"))) / F.sum(F.pow(F.col(TIME) - F.col("mt_"), 2))).alias("slope_"))
    return c.join(s, KEY).withColumn(f"detrended_{column}", F.col(column) - F.col("mx_") - F.col("slope_") * (F.col(TIME) - F.col("mt_"))).drop("mt_", "mx_", "slope_")


def moving_average(df: DataFrame, column: str, radius: int) -> DataFrame:
    """Centred mean over radius rows to either side, cut at the ends."""
    if radius < 1:
        raise ValueError("radius must be positive")
    return within_rows(df, radius, radius, lambda rows, w: rows.withColumn(f"ma_{column}", F.avg(column).over(w.rowsBetween(-radius, radius))))


def winsorize(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.join(quantiles_by(df, column, [KEY], (low, high), "q_"), KEY).withColumn(f"w_{column}", F.greatest(F.least(F.col(column), F.col("q_")[1]), F.col("q_")[0])).drop("q_")


def impute_forward(df: DataFrame, column: str) -> DataFrame:
    return nearest_known(df, F.col(column), f"filled_{column}", None)


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    m = df.groupBy(KEY).agg(F.avg(column).alias("m_"))
    return df.join(m, KEY).withColumn(f"filled_{column}", F.coalesce(column, "m_")).drop("m_")


def impute_linear(df: DataFrame, column: str) -> DataFrame:
    """Between the nearest known values; nulls before the first or after the last stay null (the caller decides if that is an error)."""
    out = nearest_known(df, F.when(F.col(column).isNotNull(), F.struct(TIME, column)), "a_", "b_")
    line = F.col("a_")[column] + (F.col("b_")[column] - F.col("a_")[column]) * (F.col(TIME) - F.col("a_")[TIME]) / (F.col("b_")[TIME] - F.col("a_")[TIME])
    return out.withColumn(f"filled_{column}", F.coalesce(column, line)).drop("a_", "b_")


def resample_linear(df: DataFrame, column: str, step: float) -> DataFrame:
    """(series_id, t, column) on a grid of multiples of step inside each series: every row makes the grid points up to the next
    one, so no range join is needed."""
    b = neighbours(df.select(KEY, TIME, column), [column])
    last = F.col(f"next_{TIME}").isNull()
    first_k = F.ceil(F.col(TIME) / step)
    last_k = F.when(last, F.floor(F.col(TIME) / step)).otherwise(F.ceil(F.col(f"next_{TIME}") / step) - 1)
    g = b.where(first_k <= last_k).withColumn("k_", F.explode(F.sequence(first_k, last_k)))
    at = F.col("k_") * F.lit(float(step))
    value = F.when(last | (at == F.col(TIME)), F.col(column)).otherwise(F.col(column) + (F.col(f"next_{column}") - F.col(column)) * (at - F.col(TIME)) / (F.col(f"next_{TIME}") - F.col(TIME)))
    return g.select(KEY, at.alias(TIME), value.alias(column))


def align(df: DataFrame, targets: DataFrame, column: str, clamp: bool = True) -> DataFrame:
    """The column interpolated onto the targets' times (series_id, t): an as-of bracket by one union and a window.

    clamp: outside the range the end values hold; else they are null.
    """
    known = F.when(F.col("own_"), F.struct(F.col(TIME).alias("t"), F.col("v_").alias("v")))
    both = df.select(KEY, TIME, F.col(column).alias("v_"), F.lit(True).alias("own_")).union(targets.select(KEY, TIME, F.lit(None).cast("double"), F.lit(False)))
    # Of rows at one time, the known one comes first, either way.
    out = nearest_known(both, known, "a_", "b_", ([F.col(TIME).asc(), F.col("own_").desc()], [F.col(TIME).desc(), F.col("own_").desc()]))
    a, b = F.col("a_"), F.col("b_")
    inside = F.when(a["t"] == b["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(TIME) - a["t"]) / (b["t"] - a["t"]))
    value = F.when(a.isNotNull() & b.isNotNull(), inside)
    return out.where("NOT own_").select(KEY, TIME, (F.coalesce(value, a["v"], b["v"]) if clamp else value).alias(column))


def prepared(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """Steps of preparation in order, each on the value columns: trim (start, end), smooth (radius), detrend, standardize,
    resample (step; one column), winsorize (low, high), drop_constant."""
    for kind, *args in steps:
        values = value_columns(df)
        if kind == "trim":
            df = trim(df, *args)
        elif kind == "drop_constant":
            df = drop_constant(df)
        elif kind == "resample":
            if len(values) != 1:
                raise ValueError("one column at a time is resampled")
            df = resample_linear(df, values[0], *args)
        elif kind in ("smooth", "detrend", "standardize", "winsorize"):
            rule, name = {"smooth": (moving_average, "ma"), "detrend": (detrend_linear, "detrended"), "standardize": (standardize, "z"), "winsorize": (winsorize, "w")}[kind]
            for c in values:
                df = rule(df, c, *args)
            df = df.select(KEY, TIME, *[df[f"{name}_{c}"].alias(c) for c in values])
        else:
            raise ValueError(f"no such step: {kind}")
    return df


def batches(df: DataFrame, size: int) -> DataFrame:
    return numbered(df).withColumn("batch", F.floor(F.col("rn_") / size)).drop("rn_")


def sliding_windows(df: DataFrame, width: int, step: int, column: str) -> DataFrame:
    """Complete windows of width rows, every step rows: (series_id, window, start_t, end_t, n, mean)."""
    r = numbered(df)
    n = r.groupBy(KEY).agg(F.max("rn_").alias("n_"))
    low = F.greatest(F.lit(0), F.ceil((F.col("rn_") - width + 1) / step))
    high = F.least(F.floor(F.col("rn_") / step), F.floor((F.col("n_") + 1 - width) / step))
    e = r.join(n, KEY).where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    return e.groupBy(KEY, "window").agg(F.min(TIME).alias("start_t"), F.max(TIME).alias("end_t"), F.count("*").alias("n"), F.avg(column).alias("mean"))


def staged(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """select, rename, filter (column, op, value), fill_null (column, value), drop_null (columns), in the order given.

    Ordering comparisons are false on nulls, as are eq and ne of a null, so filters keep no row by accident.
    """
    ops = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "in": lambda a, b: a.isin(b)}
    for kind, *args in steps:
        if kind == "select":
            df = df.select(*args[0])
        elif kind == "rename":
            df = df.withColumnsRenamed(args[0])
        elif kind == "filter":
            df = df.where(ops[args[1]](F.col(args[0]), args[2]))
        elif kind == "fill_null":
            df = df.fillna({args[0]: args[1]})
        elif kind == "drop_null":
            df = df.dropna(subset=args[0])
        else:
            raise ValueError(f"no such stage: {kind}")
    return df

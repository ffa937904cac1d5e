"""Profiles of columns, of what is missing and of time axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import KEY, TIME, nearest_known, neighbours, numbered


def columns_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, min, max, mean, var_pop, var_samp, in one aggregate that is then turned into rows."""
    agg = df.agg(*[F.struct(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.var_pop(c).alias("var_pop"), F.var_samp(c).alias("var_samp")).alias(c) for c in columns])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")


#: Rows of a group whose quantiles are taken from its values in one task; quantiles of larger ones are narrowed down first.
SELECT_ROWS, SELECT_GRID, SELECT_ACCURACY = 1_000_000, 1000, 10_000


def quantiles_by(df: DataFrame, column: str, keys: list[str], at: tuple[float, ...], name: str = "q", select_rows: int | None = None) -> DataFrame:
    """keys and an array of linear quantiles, exact, of the non-null values.

    Where no group has more than select_rows values, one aggregate takes them. Else each rank is narrowed down: a sketch of
    bounded size of the values between the bounds so far gives new bounds about the rank, and a count says whether they hold it, until few values are left
    between them or all are equal, a few hundred times fewer in each round. What moves is sketches and counts; no task holds a group's values.
    """
    most = select_rows or SELECT_ROWS
    values = df.select(*keys, F.col(column).cast("double").alias("v_")).where("v_ IS NOT NULL")
    n = values.groupBy(*keys).agg(F.count("*").alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    if (n.agg(F.max("n_")).first()[0] or 0) <= most:
        return values.groupBy(*keys).agg(F.percentile("v_", F.array(*[F.lit(float(p)) for p in at])).alias(name))
    places = F.array(*[F.struct(F.lit(k).alias("k_"), F.lit(float(p)).alias("p_")) for k, p in enumerate(at)])
    # (keys, k): the rank wanted, how many values lie before the bounds, the bounds, how many lie within.
    todo = n.select(*keys, "n_", "lo_", "hi_", F.explode(places).alias("a_")).select(*keys, "a_.*", F.floor(F.col("a_.p_") * (F.col("n_") - 1)).cast("long").alias("rank_"), F.lit(0).cast("long").alias("before_"), "lo_", "hi_", F.col("n_").alias("in_"), "n_")
    done: list[DataFrame] = []
    session = df.sparkSession
    while True:
        rows = todo.collect()  # one a group and quantile
        kind = todo.schema
        open_ = [r for r in rows if r["in_"] > most and r["lo_"] < r["hi_"]]
        done.append(session.createDataFrame([r for r in rows if not (r["in_"] > most and r["lo_"] < r["hi_"])], kind))
        if not open_:
            break
        wanted = F.broadcast(session.createDataFrame(open_, kind).alias("w"))
        same = reduce(lambda x, c: x & F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")), keys, F.lit(True))
        inside = values.alias("v").join(wanted, same & F.col("v.v_").between(F.col("w.lo_"), F.col("w.hi_"))).select("w.*", "v.v_")
        grid = F.percentile_approx("v_", F.lit([i / SELECT_GRID for i in range(SELECT_GRID + 1)]), SELECT_ACCURACY)
        group = [*keys, "k_", "p_", "rank_", "before_", "n_", "in_"]
        sketched = inside.groupBy(*group, "lo_", "hi_").agg(grid.alias("g_"))
        step = F.floor((F.col("rank_") - F.col("before_")) / F.col("in_") * SELECT_GRID).cast("int")
        low, high = F.col("g_")[F.greatest(step - 1, F.lit(0))], F.col("g_")[F.least(step + 2, F.lit(SELECT_GRID))]
        kind_ = sketched.select(*group, F.when(step > 1, low).otherwise(F.col("lo_")).alias("a_"), F.when(step + 2 < SELECT_GRID, high).otherwise(F.col("hi_")).alias("b_"), "lo_", "hi_")
        bounds = F.broadcast(session.createDataFrame(kind_.collect(), kind_.schema).alias("w"))
        held = values.alias("v").join(bounds, same & F.col("v.v_").between(F.col("w.lo_"), F.col("w.hi_"))).select("w.*", "v.v_")
        now = F.col("v_").between(F.col("a_"), F.col("b_"))
        counted = held.groupBy(*group, "lo_", "hi_").agg(F.count_if(F.col("v_") < F.col("a_")).alias("below_"), F.count_if(now).alias("c_"), F.min(F.when(now, F.col("v_"))).alias("x_"), F.max(F.when(now, F.col("v_"))).alias("y_"))
        start = F.col("before_") + F.col("below_")
        good = (F.col("rank_") >= start) & (F.col("rank_") < start + F.col("c_")) & (F.col("c_") < F.col("in_"))
        pick = lambda new, old: F.when(good, new).otherwise(old)
        todo = counted.select(*keys, "k_", "p_", "rank_", pick(start, F.col("before_")).alias("before_"), pick(F.col("x_"), F.col("lo_")).alias("lo_"), pick(F.col("y_"), F.col("hi_")).alias("hi_"), pick(F.col("c_"), F.lit(0)).alias("in_"), "n_")
    ready = F.broadcast(reduce(DataFrame.union, done).alias("w"))
    same = reduce(lambda x, c: x & F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")), keys, F.lit(True))
    # Distinct values between the bounds with their counts, and the next one beyond: the rank's value and its successor.
    near = values.alias("v").join(ready, same & (F.col("v.v_") >= F.col("w.lo_"))).select("w.*", "v.v_")
    beyond = near.where("v_ > hi_").groupBy(*keys, "k_").agg(F.min("v_").alias("beyond_"))
    within = near.where("v_ <= hi_").groupBy(*keys, "k_", "p_", "rank_", "before_", "n_", "v_").agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*keys, "k_").orderBy("v_")
    found = within.withColumn("to_", F.col("before_") + F.sum("c_").over(w)).withColumn("next_", F.lead("v_").over(w)).where("rank_ < to_ AND rank_ >= to_ - c_")
    found = found.alias("f").join(beyond.alias("b"), reduce(lambda x, c: x & F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")), [*keys, "k_"], F.lit(True)), "left").select("f.*", "beyond_")
    after = F.when(F.col("rank_") + 1 < F.col("to_"), F.col("v_")).otherwise(F.coalesce("next_", "beyond_", "v_"))
    share = F.col("p_") * (F.col("n_") - 1) - F.col("rank_")
    value = F.when(share > 0, F.col("v_") + (after - F.col("v_")) * share).otherwise(F.col("v_"))
    got = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k_", value.alias("q")))).alias("q_"))
    return got.select(*keys, F.transform("q_", lambda x: x["q"]).alias(name))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Linear quantiles, exact; one row a column. All columns are read in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")
    return quantiles_by(long, "value", ["column"], at).select("column", *[F.col("q")[k].alias(f"q{round(100 * p)}") for k, p in enumerate(at)])


def mad(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Median and median absolute deviation by keys."""
    m = quantiles_by(df, column, keys, (0.5,)).select(*keys, F.col("q")[0].alias("median"))
    gaps = df.join(m, keys).withColumn("gap_", F.abs(F.col(column) - F.col("median")))
    return m.join(quantiles_by(gaps, "gap_", keys, (0.5,)).select(*keys, F.col("q")[0].alias("mad")), keys)


def tukey_outliers(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of the quartiles of their keys."""
    q = quantiles_by(df, column, keys, (0.25, 0.75), "q_")
    iqr = F.col("q_")[1] - F.col("q_")[0]
    return df.join(q, keys).where((iqr > 2.220446049250313e-16) & ~F.col(column).between(F.col("q_")[0] - 1.5 * iqr, F.col("q_")[1] + 1.5 * iqr)).drop("q_")


def missingness(df: DataFrame, column: str) -> DataFrame:
    """Per series: rows, missing ones and the longest run of missing ones."""
    gone = F.col(column).isNull() | F.isnan(column)
    # A run is what follows one known row: told apart by that row's number.
    rows = nearest_known(numbered(df.select(KEY, TIME, gone.alias("gone_"))), F.when(~F.col("gone_"), F.col("rn_")), "run_", None)
    lengths = rows.groupBy(KEY, "run_").agg(F.count("*").alias("n_"), F.sum(F.col("gone_").cast("long")).alias("m_"))
    return lengths.groupBy(KEY).agg(F.sum("n_").alias("total"), F.sum("m_").alias("missing"), F.max("m_").alias("longest_run"))


def time_profile(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per series: start, end, n, nominal step, step statistics, whether all steps equal the first within the tolerance."""
    steps = neighbours(df.select(KEY, TIME), []).withColumn("step_", F.col(f"next_{TIME}") - F.col(TIME))
    first = F.min_by("step_", F.when(F.col("step_").isNotNull(), F.col(TIME)))
    out = steps.groupBy(KEY).agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count("*").alias("n"), F.min("step_").alias("min_step"), F.max("step_").alias("max_step"), F.avg("step_").alias("mean_step"), F.stddev_pop("step_").alias("sd_step"), first.alias("first_"))
    room = tolerance * F.greatest(F.lit(1.0), F.abs("first_"))
    return out.select(KEY, "start", "end", "n", F.try_divide(F.col("end") - F.col("start"), F.col("n") - 1).alias("nominal_step"), "min_step", "max_step", "mean_step", F.try_divide(F.col("sd_step"), F.col("mean_step")).alias("step_cv"), ((F.col("max_step") - F.col("first_") <= room) & (F.col("first_") - F.col("min_step") <= room)).alias("regular"))

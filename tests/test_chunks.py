"""Long series in chunks give what one window gives, however their rows are spread over time."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright import frames
from tidewright.frames import KEY, TIME
from tidewright.operators import derivative, features, prep, profile


@pytest.fixture(scope="module")
def series(spark):
    """Regular, all in a burst, with one far outlier, short, and of one row; values with gaps."""
    rng = random.Random(5)
    rows = [("regular", float(k)) for k in range(400)] + [("burst", 1000 + k * 1e-9) for k in range(300)] + [("burst", 0.0), ("burst", 1e9)]
    rows += [("far", rng.random()) for _ in range(200)] + [("far", 1e12)] + [("short", float(k)) for k in range(3)] + [("one", 1.0)]
    rows = [(s, t, None if rng.random() < 0.3 else rng.gauss(0, 1), rng.gauss(0, 1)) for s, t in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, t double, x double, y double").cache()


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_chunks_hold_few_rows_in_order(series):
    got = frames.chunked(series, 10).orderBy(KEY, TIME).collect()
    assert len(got) == series.count()
    sizes, order = {}, {}
    for r in got:
        sizes[r[KEY], r.chunk_] = sizes.get((r[KEY], r.chunk_), 0) + 1
        assert order.get(r[KEY], -1) <= r.chunk_
        order[r[KEY]] = r.chunk_
    assert max(n for (s, _), n in sizes.items()) <= 20


@pytest.mark.parametrize("size", [1, 40])
def test_numbers_sums_and_known_values(series, size):
    w = Window.partitionBy(KEY).orderBy(TIME)
    want = series.withColumn("rn_", F.row_number().over(w).cast("long") - 1)
    assert rows_of(frames.numbered(series, "rn_", size)) == rows_of(want)
    total = F.coalesce(F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a, b = (rows_of(d.select(KEY, "rn_", F.round("s", 9))) for d in (frames.running_sum(series, "y", "s", size), want.withColumn("s", total)))
    assert a == b
    back = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    assert rows_of(frames.nearest_known(series, F.col("x"), "a", "b", None, size)) == rows_of(series.withColumn("a", back).withColumn("b", ahead))


@pytest.mark.parametrize("size", [7])
def test_operators_on_chunks(series, monkeypatch, size):
    known = series.withColumn("x", F.col("y"))
    runs = {
        "average": lambda: prep.moving_average(known, "x", 3), "forward": lambda: prep.impute_forward(series, "x"), "linear": lambda: prep.impute_linear(series, "x"),
        "batches": lambda: prep.batches(series, 10), "windows": lambda: prep.sliding_windows(known, 5, 2, "x"), "runs": lambda: profile.missingness(series, "x"),
        "delays": lambda: features.delay_embedding(known, "x", [0, 2, 5]), "difference": lambda: derivative.finite_difference(known.where("series_id != 'one'"), ["x"]), "slope": lambda: derivative.savitzky_golay(known.where("series_id = 'regular'"), "x", 5),
        "align": lambda: prep.align(known, known.select(KEY, (F.col(TIME) + 0.5).alias(TIME)), "x"), "time": lambda: profile.time_profile(series),
    }
    flat = lambda df: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows_of(df)]
    want = {k: sorted(flat(f()), key=repr) for k, f in runs.items()}
    monkeypatch.setattr(frames, "CHUNK_ROWS", size)
    for k, f in runs.items():
        assert sorted(flat(f()), key=repr) == want[k], k


@pytest.mark.parametrize("at", [(0.0, 0.25, 0.5, 1.0), (0.05, 0.333, 0.95)])
def test_quantiles_narrowed_down(spark, at):
    rng = np.random.default_rng(3)
    parts = {"even": rng.random(3000), "ties": rng.integers(0, 4, 2000).astype(float), "wide": np.exp(rng.normal(0, 20, 2500)) * rng.choice([-1, 1], 2500), "equal": np.full(900, 7.0), "few": np.array([3.0, 1.0]), None: rng.normal(0, 1, 1500), "far": np.append(rng.random(1200), 1e300)}
    rows = [(k, float(v)) for k, vs in parts.items() for v in vs] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for most in (50, 100_000):
        got = {r.k: r.q for r in profile.quantiles_by(df, "v", ["k"], at, select_rows=most).collect()}
        assert got.keys() == parts.keys()
        for k, vs in parts.items():
            assert np.allclose(got[k], np.quantile(vs, at), rtol=1e-12, atol=0), (k, most)

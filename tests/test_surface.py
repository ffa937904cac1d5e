"""Estimators, plugins, event logs and the watch over laws: what they find, what they refuse, batch and stream alike."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright import estimators
from tidewright.frames import KEY, TIME
from tidewright.sources import plugins
from tidewright.streaming import events, laws


def switched(n=240, at=120):
    """x' = 0.3 x, then x' = -0.4 x; y' = 0.1 y throughout."""
    t = np.arange(n) * 0.05
    x = np.where(np.arange(n) < at, np.exp(0.3 * t), np.exp(0.3 * at * 0.05 - 0.4 * (t - at * 0.05)))
    return t, np.stack([x, np.exp(0.1 * t)], axis=1)


def test_watch_finds_the_switch():
    t, x = switched()
    found = laws.Watch(["x", "y"], window=24, degree=1, threshold=0.02).add(t, x)
    assert [r["kind"] for r in found] == ["initial", "update"] and found[1]["start_row"] == 144 and found[1]["window"] == 6 and found[1]["sustained"] == 2
    first, last = (json.loads(r["laws"]) for r in found)
    assert first["x"]["x"] == pytest.approx(0.3, abs=1e-3) and last["x"]["x"] == pytest.approx(-0.4, abs=1e-3) and last["y"]["y"] == pytest.approx(0.1, abs=1e-3)
    assert found[1]["prior_revision"] == found[0]["revision"] != found[1]["revision"]
    assert {(d["state"], d["term"]) for d in json.loads(found[1]["diff"])} >= {("x", "x")}


@pytest.mark.parametrize("options", [{"window": 24, "degree": 1}, {"window": 24, "step": 7, "degree": 1, "growing": True}, {"window": 30, "step": 10, "degree": 2, "sustain": 1}])
def test_watch_is_the_same_in_any_batches(options):
    t, x = switched()
    whole = laws.Watch(["x", "y"], **options).add(t, x)
    state, got = None, []
    for a in range(0, len(t), 11):
        w = laws.Watch(["x", "y"], **options, state=state)
        got += w.add(t[a : a + 11], x[a : a + 11])
        state = w.state()
    assert got == whole and len(whole) >= 2
    with pytest.raises(ValueError):
        laws.Watch(["x", "y"], **options, state=state).add(t[:1], x[:1])


def test_growing_windows():
    t, x = switched(60, 60)
    w = laws.Watch(["x", "y"], window=32, step=10, degree=1, growing=True)
    seen = []
    w._window = lambda a, b, start: seen.append((start, start + len(a)))  # noqa: SLF001
    w.add(t, x)
    assert seen == [(0, 10), (0, 20), (0, 30), (0, 32), (10, 42), (20, 52)]
    with pytest.raises(ValueError):
        laws.Watch(["x"], window=4)


def test_watch_as_batch_and_stream(spark, tmp_path):
    t, x = switched()
    rows = [(s, float(a), float(b), float(c)) for s in ("p", "q") for a, (b, c) in zip(t, x, strict=True)]
    df = spark.createDataFrame(rows, "series_id string, t double, x double, y double")
    batch = laws.history(df, ["x", "y"], window=24, degree=1)
    assert laws.change_points(batch).count() == 2
    for k, part in enumerate((df.where("t < 5"), df.where("t >= 5"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = laws.watch(stream, ["x", "y"], window=24, degree=1).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("watched").collect())) == sorted(map(tuple, batch.collect()))


def test_estimators(spark):
    t, x = switched(120, 120)
    df = spark.createDataFrame([("s", float(a), float(b), float(c)) for a, (b, c) in zip(t, x, strict=True)], "series_id string, t double, x double, y double")
    model = estimators.Dynamics(["x", "y"], degree=1, threshold=0.05).fit(df)
    assert set(model.equations()) == {"x", "y"} and min(model.score(df).values()) > 0.99
    assert model.transform(df).columns[-2:] == ["predicted_d_x", "predicted_d_y"]
    z = df.withColumn("z", 2 + 3 * F.col("x") - F.col("x") * F.col("y"))
    fit = estimators.Regression(["x", "y"], "z", 2, 0.1).fit(z)
    assert fit.score(z) > 0.999999 and "prediction" in fit.transform(z).columns
    lib = estimators.Library(["x", "y"], 2, 0.9).fit(df)
    assert lib.names[0] in ("x", "y") and 1 <= len(lib.names) < 5 and set(lib.names) <= set(lib.transform(df).columns)
    assert estimators.best_predictor(z, ["y", "x"], "x").first()["column"] == "x"


def test_plugins(spark):
    r = plugins.Registry(frozenset({"read_data"}))
    double = lambda b: pa.RecordBatch.from_arrays([pa.array([None if v is None else 2 * v for v in b.column(0).to_pylist()], pa.int64())], ["v"])
    r.register(plugins.Manifest("twice", "1.0.0", "v long", frozenset({"read_data"})), double)
    assert sorted(x.v for x in r.apply(spark.range(5), "twice").collect()) == [0, 2, 4, 6, 8]
    for bad, kind in ((plugins.Manifest("twice", "1.0.0", "v long"), ValueError), (plugins.Manifest("net", "1.0.0", "v long", frozenset({"network"})), PermissionError), (plugins.Manifest("odd", "1.0.0", "v long", frozenset({"magic"})), ValueError), (plugins.Manifest("Bad", "1", "v long"), ValueError)):
        with pytest.raises(kind):
            r.register(bad, double)
    r.register(plugins.Manifest("wrong", "1.0.0", "w long"), double)
    r.register(plugins.Manifest("many", "1.0.0", "v long", most_rows=2), double)
    for name in ("wrong", "many"):
        with pytest.raises(Exception, match="columns|allowed"):
            r.apply(spark.range(5, numPartitions=1), name).collect()
    bars = spark.createDataFrame([("2024-01-01T00:00:00Z", 1.0, 3.0, 0.5, 2.0, 9.0)], "time string, open double, high double, low double, close double, volume double")
    assert plugins.daily_prices(bars, {}).count() == 1
    with pytest.raises(Exception, match="cannot be"):
        plugins.daily_prices(bars.withColumn("low", F.lit(9.0)), {}).collect()
    text = plugins.report("R", {"a": [{"k": "x|y", "v": 1}], "b": {"n": 2}, "c": "words"})
    assert text.splitlines()[:4] == ["# R", "## a", "| k | v |", "|-|-|"] and "x\\|y" in text and json.loads(plugins.report("R", {"b": {"n": 2}}, "json"))["sections"] == {"b": {"n": 2}}


def test_event_log(spark):
    df = spark.createDataFrame([("a", 10 + k, k) for k in range(6)] + [("b", 1, 0)], "scope string, at long, v int")
    numbered = events.sequenced(df, "scope", "at")
    assert [r.sequence for r in events.events_after(numbered, "scope", "a", 4).collect()] == [5, 6]
    assert sorted((r.scope, r.sequence) for r in events.retained(numbered, "scope", 2).collect()) == [("a", 5), ("a", 6), ("b", 1)]
    assert events.out_of_order(numbered, "scope", "at").count() == 0
    assert events.out_of_order(numbered.withColumn("sequence", F.least("sequence", F.lit(3))), "scope", "at").count() == 3
    assert {KEY, TIME}.isdisjoint(numbered.columns)

"""Controls, optimisers, holdouts, regimes and sources against closed forms and brute force."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import expressions as ex
from tidewright.plans import discovery, linear, worlds
from tidewright.plans.discovery import World
from tidewright.sources import connectors
from tidewright.sources.readers import ReadRequest


def test_gains_and_modes():
    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 3)) / 2, rng.normal(size=(3, 1)), rng.normal(size=(1, 3))
    gain = linear.observer_gain(a, c, [-1.0, -2.0, -3.0])
    assert np.allclose(np.sort(np.linalg.eigvals(a - gain @ c).real), [-3, -2, -1], atol=1e-6)
    q, r, x = np.eye(3), np.eye(1), np.array([1.0, -2.0, 0.5])
    free = linear.bounded_mpc(a, b, q, r, x, 6, -1e9, 1e9, 20_000)
    assert np.allclose(free[0], -linear.mpc_gain(a, b, q, r, 6) @ x, atol=1e-6)
    tight = linear.bounded_mpc(a, b, q, r, x, 6, -0.1, 0.1)
    assert np.abs(tight).max() <= 0.1 and np.abs(tight).max() > 0.09
    assert np.allclose(linear.mpc_gain(a, b, q, r, 500), linear.dlqr(a, b, q, r), atol=1e-8)
    turn = np.array([[0.0, -0.9], [0.9, 0.0]])
    (z, w), _ = linear.modes(turn, 0.5)
    assert abs(z) == pytest.approx(0.9) and w.real == pytest.approx(np.log(0.9) / 0.5) and abs(w.imag) == pytest.approx(np.pi)
    stable = a - 2 * np.eye(3)
    assert np.allclose(stable @ linear.controllability_gramian(stable, b) + linear.controllability_gramian(stable, b) @ stable.T, -b @ b.T)
    assert np.allclose(stable.T @ linear.observability_gramian(stable, c) + linear.observability_gramian(stable, c) @ stable, -c.T @ c)


def test_optimisers():
    rose = lambda x: float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2)
    slope = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    assert np.allclose(worlds.lbfgs(rose, slope, np.array([-1.2, 1.0]), rounds=2000), [1, 1], atol=1e-6)
    best, low, high = worlds.quadratic_profile([(v, 2 * (v - 3) ** 2 + 7) for v in (1.0, 2.0, 4.0, 5.5)])
    assert best == pytest.approx(3) and high - best == pytest.approx(best - low) == pytest.approx((1.920729410347062 / 2) ** 0.5)
    for points in ([(1.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (1.0, -1.0), (2.0, -4.0)]):
        with pytest.raises(ValueError):
            worlds.quadratic_profile(points)
    assert ex.evaluate(worlds.crossover_sum(ex.parse("x*x"), worlds.mutate_symbol(ex.parse("x + 1"), "x", "y")), {"x": 3.0, "y": 5.0}) == 15


def test_controlled():
    """x' = -x + u with u = t has x = t - 1 + 2 exp(-t) from 1."""
    world = World(["x"], {"x": ex.parse("u - x")}, {}, {})
    t = np.arange(201) * 0.01
    got = discovery.controlled(world, {"u": (np.array([0.0, 2.0]), np.array([0.0, 2.0]))}, np.array([1.0]), 0.01, 200)[:, 0]
    assert np.allclose(got, t - 1 + 2 * np.exp(-t), atol=1e-9)


def test_regime_laws(spark):
    """Two stretches of unlike mean, each with its own rate."""
    t = np.arange(200) * 0.05
    x = np.where(np.arange(200) < 100, np.exp(0.3 * t), 40 * np.exp(-0.2 * (t - 5)))
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, x, strict=True)], "series_id string, t double, x double")
    rows = discovery.regime_laws(df, "x", 1, 0.05, 8000.0).collect()
    assert {(r.segment, r.term): round(r.coefficient, 2) for r in rows} == {(0, "x"): 0.3, (1, "x"): -0.2}
    assert {(r.start_t, r.end_t) for r in rows} == {(0.0, t[99]), (t[100], t[-1])}


def test_holdout_of_a_constant(spark):
    df = spark.createDataFrame([("s", 2.0, 2.0, 2.0)] * 3, "series_id string, x double, p double, o double")
    r = discovery.holdout_scores(df, "x", "p", "o").first()
    assert (r.n, r.rmse, r.r2, r.skill) == (3, 0.0, None, None)


def test_sources(spark, tmp_path):
    s = connectors.sources()
    df = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert s.scan(spark, "parquet", ReadRequest(("k",), {"v": "v3"}), path=str(tmp_path / "p")).collect()[0].k == 3
    assert [len(b) for b in s.batches(spark, "parquet", 3, path=str(tmp_path / "p"))] == [3, 3, 1]
    assert s.inspect(spark, "parquet", path=str(tmp_path / "p")) == [("k", "bigint"), ("v", "string")]
    assert s.healthy(spark, "parquet", path=str(tmp_path / "p")) and not s.healthy(spark, "parquet", path=str(tmp_path / "none"))
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (k INTEGER)")
        db.execute("INSERT INTO t VALUES (4)")
    assert s.scan(spark, "sqlite", path=str(tmp_path / "d.db"), query="SELECT k FROM t", schema="k long").first().k == 4
    with pytest.raises(ValueError):
        s.register("csv", None)
    with pytest.raises(ValueError):
        s.scan(spark, "carrier pigeon")
    o = connectors.jdbc_options("jdbc:postgresql://h/d", "SELECT a FROM t; ", "a", (0, 100), 4)
    assert o["dbtable"] == "(SELECT a FROM t) AS q" and (o["partitionColumn"], o["numPartitions"]) == ("a", "4")
    for bad in (("http://h", "SELECT 1"), ("jdbc:x", "DELETE FROM t")):
        with pytest.raises(ValueError):
            connectors.jdbc_options(*bad)
    with pytest.raises(ValueError):
        connectors.jdbc_options("jdbc:x", "SELECT 1", None, None, 4)
    assert connectors.kafka_options("h:1", "t")["endingOffsets"] == "latest"
    with pytest.raises(ValueError):
        connectors.kafka_options("h:1", "a,b")
    prints = connectors.file_fingerprints(spark, str(tmp_path / "p/*.parquet")).collect()
    assert len(prints) == 1 and len(prints[0].sha256) == 64
    for k in (1, 2):
        connectors.replace_atomically(df.withColumn("n", F.lit(k)), str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).select("n").distinct().first().n == k
    assert not (tmp_path / "out.new").exists() and not (tmp_path / "out.old").exists()
    assert df.where(connectors.partition_filter({"v": "v1", "k": 1})).count() == 1


def test_normal_form():
    import random

    from tidewright.functions import normal_form as nf

    assert ex.to_text(nf.normal(ex.parse("0 + (x*1) + (y - y)"))) == "x"
    assert ex.to_text(nf.normal(ex.parse("(x + y)^2 - x*x - y*y"))) == "2 * (x * y)"
    assert nf.same(ex.parse("(a + b)*(a - b)"), ex.parse("a^2 - b*b")) and not nf.same(ex.parse("a + b"), ex.parse("a - b"))
    assert ex.to_text(nf.shortest(ex.parse("x*y + x*y + 0*z"))) == "2 * (x * y)" and nf.cheapest([]) is None
    assert nf.same(ex.parse("sin(x + x) / 2"), ex.parse("0.5 * sin(2 * x)"))
    rng = random.Random(3)

    def grow(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice([("sym", "x"), ("sym", "y"), ex.num(rng.randrange(-3, 4))])
        kind = rng.choice(["+", "-", "*", "*", "sin", "neg", "^"])
        return ("^", grow(depth - 1), ex.num(2)) if kind == "^" else (kind, grow(depth - 1)) if kind in ("sin", "neg") else (kind, grow(depth - 1), grow(depth - 1))

    for _ in range(200):
        e, at = grow(4), {"x": rng.uniform(-1, 1), "y": rng.uniform(-1, 1)}
        n = nf.normal(e)
        assert ex.evaluate(n, at) == pytest.approx(ex.evaluate(e, at), rel=1e-9, abs=1e-7) and nf.normal(n) == n
        assert ex.size(nf.shortest(e)) <= ex.size(e)


def test_samples_and_ensembles():
    from tidewright.operators.resampling import without_replacement

    assert sorted(without_replacement(50, 50, 4)) == list(range(50)) and without_replacement(50, 7, 4) == without_replacement(50, 50, 4)[:7]
    assert len(set(without_replacement(10**12, 1000, 9))) == 1000
    with pytest.raises(ValueError):
        without_replacement(3, 4, 0)
    rates = np.array([-0.5, -0.6, -0.7, 40.0])
    bands = discovery.ensemble_forecast(["x"], ["1", "x"], np.array([[[0.0, r]] for r in rates[:3]]), np.array([2.0]), 0.01, 100, 0.0, 1.0)
    assert np.allclose(bands["x"][-1], 2 * np.exp([-0.7, -0.6, -0.5])) and np.allclose(bands["x"][0], 2)
    with pytest.raises(ValueError):
        discovery.ensemble_forecast(["x"], ["x*x"], np.array([[[1e9]]]), np.array([1e9]), 1.0, 50)

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import expressions as ex
from tidewright.functions import units
from tidewright.operators import resampling
from tidewright.plans import discovery, fields, worlds


def frame(spark, t, x):
    return spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, x, strict=True)], "series_id string, t double, x double")


def test_units():
    assert units.conversion(units.parse_unit("km/h"), units.parse_unit("m/s")) == pytest.approx(1 / 3.6)
    assert units.parse_unit("kg*m/s^2").dimension == units.parse_unit("N").dimension
    d = {"v": units.parse_unit("m/s").dimension, "l": units.parse_unit("m").dimension, "g": units.parse_unit("m/s^2").dimension}
    assert units.dimension_of(ex.parse("v^2/l + 3*g"), d) == d["g"]
    with pytest.raises(ValueError):
        units.dimension_of(ex.parse("v + l"), d)
    (group,) = units.dimensionless_groups(d)
    assert sum(np.array(d[n]) * k for n, k in group.items()).tolist() == [0] * 7
    with pytest.raises(ValueError):
        units.parse_unit("parsec")


def test_heat_equation(spark):
    x, t = np.arange(60) * 0.1, np.arange(40) * 0.01
    u = [[np.exp(-0.5 * a) * np.sin(b) + 0.5 * np.exp(-0.5 * 4 * a) * np.cos(2 * b) for b in x] for a in t]
    df = spark.createDataFrame([(i, j, float(u[i][j])) for i in range(40) for j in range(60)], "t_idx int, x_idx int, u double")
    assert fields.discover_field(df, 0.01, 0.1, degree=1, order=2, threshold=0.1) == pytest.approx({"u_2": 0.5}, abs=0.01)


def test_weak_form(spark):
    t = np.linspace(0, 6, 400)
    k = np.exp(0.8 * t)
    x = 10 * k / (9 + k)
    rng = np.random.default_rng(2)
    got = fields.weak_discover(frame(spark, t, x + 0.01 * rng.standard_normal(400)), "x", degree=2, threshold=0.02)
    assert got["x"] == pytest.approx(0.8, abs=0.05) and got["x*x"] == pytest.approx(-0.08, abs=0.01)


def test_downsample(spark):
    t = np.arange(500.0)
    v = np.where(t == 250, 50.0, np.sin(t / 20))
    at = fields.downsample(t, v, 40)
    assert len(at) == 40 and {0, 250, 499} <= set(at.tolist()) and np.all(np.diff(at) > 0)
    assert fields.decimate(frame(spark, t, v), "x", 40).count() == 40


def test_bootstrap(spark):
    assert resampling.split_mix(0, 1) == [0xE220A8397B1DCDAF]
    at = resampling.block_indices(50, 8, 3)
    assert len(at) == 50 and at.max() < 50 and np.array_equal(np.diff(at[:8]) % 50, [1] * 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal(120)
    df = frame(spark, np.arange(120), x).withColumn("y", 2 * F.col("x"))
    grams = resampling.replicate_grams(df, [("1", F.lit(1.0)), ("x", F.col("x"))], ("y", F.col("y")), 6)
    assert len(grams) == 6 and all(g.n == 120 for g in grams)
    weights = np.bincount(resampling.block_indices(120, 8, resampling.split_mix(0, 1)[-1]), minlength=120)
    assert grams[0].g[1, 1] == pytest.approx((weights * x * x).sum())
    assert resampling.stability_selection(grams, threshold=0.1) == ([0.0, 1.0], 1.0)
    assert resampling.coefficient_bootstrap(grams, threshold=0.1)[1]["mean"] == pytest.approx(2)
    assert resampling.e_value(2.0) == pytest.approx(2 + 2**0.5) and resampling.structural_score([1.0, 1.0]) == pytest.approx(0.5)


def test_worlds(spark):
    w = discovery.World(["x"], {"x": ex.parse("r*x - x^3")}, {"x": {"x": 1.0}}, {})
    assert worlds.fingerprint(worlds.from_json(worlds.to_json(w))) == worlds.fingerprint(w)
    assert worlds.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert worlds.difference({"x": {"a": 1.0, "b": 2.0}}, {"x": {"b": 3.0, "c": 1.0}}) == [("x", "a", "removed", 1.0, None), ("x", "b", "changed", 2.0, 3.0), ("x", "c", "added", None, 1.0)]
    b = worlds.bind(w, {"r": 1.0})
    assert worlds.basins(b, np.array([[0.3], [-0.3], [2.0]]), 0.05, 400) == [0, 1, 0]
    with pytest.raises(ValueError):
        worlds.compose(w, b)
    df = spark.createDataFrame([(float(a), float(c), 3.0 * a * c + 1) for a in range(5) for c in range(4)], "a double, c double, y double")
    best = worlds.best_affine(df, "y", worlds.enumerate_expressions(["a", "c"], 1))
    assert best[0][2] == "a * c" and best[0][3:] == pytest.approx((3, 1))


def test_minimizers():
    f = lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2
    for rule in (worlds.coordinate_minimize, worlds.nelder_mead):
        assert rule(f, np.zeros(2)) == pytest.approx([1, -2], abs=1e-4)

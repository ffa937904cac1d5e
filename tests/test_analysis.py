import json

import numpy as np
import pytest

from tidewright.__main__ import main
from tidewright.functions import expressions as ex
from tidewright.plans import analysis, discovery


def test_implicit_law(spark):
    """x' = (1 - x) / (1 + x) has no finite polynomial."""
    world = discovery.World(["x"], {"x": ex.parse("(1 - x)/(1 + x)")}, {}, {})
    parts = [(f"s{k}", float(i * 0.01), float(v)) for k, x0 in enumerate((0.05, 3.0)) for i, (v,) in enumerate(discovery.trajectory(world, np.array([x0]), 0.01, 300))]
    p, q = analysis.implicit_law(spark.createDataFrame(parts, "series_id string, t double, x double"), "x", degree=1)
    assert set(p) == set(q) == {"1", "x"}
    for v in (0.2, 1.5, 2.5):
        assert (p["1"] + p["x"] * v) / (q["1"] + q["x"] * v) == pytest.approx((1 - v) / (1 + v), abs=0.01)


def test_invariants_and_sensitivities(spark):
    world = discovery.World(["x", "v"], {"x": ex.parse("v"), "v": ex.parse("-4*x")}, {}, {})
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.standard_normal((60, 2))], "x double, v double")
    (energy,) = analysis.invariants(df, world)
    assert energy == pytest.approx({"x*x": 1.0, "v*v": 0.25}, abs=1e-6)
    decay = discovery.World(["x"], {"x": ex.parse("-k*x")}, {}, {})
    s = analysis.sensitivities(decay, {"k": 0.5}, np.array([2.0]), 0.01, 200)
    assert s[-1, 0, 0] == pytest.approx(-2 * 2 * np.exp(-1), rel=1e-5)
    assert analysis.delta_forecast(s, np.array([[0.01]]))[-1, 0] == pytest.approx(0.1 * abs(s[-1, 0, 0]))


def test_sweep_finds_the_pitchfork():
    branch = analysis.sweep({"x": ex.parse("r*x - x^3")}, ["x"], "r", [-1.0, -0.5, 0.5, 1.0], np.array([[0.1], [1.0], [-1.0]]))
    assert analysis.turns(branch) == [0.5]
    assert sorted(k for p, _, k in branch if p == 1.0) == ["stable node", "stable node", "unstable node"]


def test_command_line(spark, tmp_path, capsys):
    t = np.arange(100) * 0.02
    (tmp_path / "a.csv").write_text("t,x\n" + "".join(f"{a},{np.exp(-0.5 * a)}\n" for a in t))
    assert main(["discover", str(tmp_path / "a.csv"), "--degree", "1"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert ex.evaluate(ex.parse(out["laws"]["x"]), {"x": 1.0}) == pytest.approx(-0.5, abs=1e-3)
    for command in ("profile", "regimes", "simulate", "backtest"):
        assert main([command, str(tmp_path / "a.csv"), "--steps", "3"], spark) == 0
        assert json.loads(capsys.readouterr().out)

"""Systems with known laws, solvers against closed forms, streaming against batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.frames import neighbours, validated
from tidewright.functions import expressions as ex
from tidewright.operators import derivative, features, regime, score, sparse
from tidewright.operators.gram import Gram, gram
from tidewright.plans import discovery, linear
from tidewright.sources import readers
from tidewright.streaming import online


def frame(spark, t, **columns):
    return spark.createDataFrame([("s", float(a), *map(float, r)) for a, *r in zip(t, *columns.values(), strict=True)], "series_id string, t double, " + ", ".join(f"{c} double" for c in columns))


def predator_prey(n=401, h=0.02):
    world = discovery.World(["prey", "pred"], {"prey": ex.parse("1.1*prey - 0.4*prey*pred"), "pred": ex.parse("0.1*prey*pred - 0.4*pred")}, {}, {})
    return world, np.arange(n) * h, discovery.trajectory(world, np.array([10.0, 5.0]), h, n - 1)


def test_discovery_recovers_predator_and_prey(spark):
    _, t, x = predator_prey()
    w = discovery.discover(frame(spark, t, prey=x[:, 0], pred=x[:, 1]), ["prey", "pred"], degree=2, threshold=0.05)
    c = w.coefficients
    assert c["prey"]["prey"] == pytest.approx(1.1, abs=0.01) and c["prey"]["pred*prey"] == pytest.approx(-0.4, abs=0.01)
    assert c["pred"]["pred"] == pytest.approx(-0.4, abs=0.01) and c["pred"]["pred*prey"] == pytest.approx(0.1, abs=0.01)
    assert {k for k, v in c["prey"].items() if v} == {"prey", "pred*prey"}
    again = discovery.trajectory(w, x[0], 0.02, 400)
    r2 = 1 - ((again - x) ** 2).sum() / ((x - x.mean(axis=0)) ** 2).sum()
    assert r2 >= 0.95
    assert discovery.refit_scores(frame(spark, t, prey=x[:, 0], pred=x[:, 1]), w)["prey"]["rss"] < 1


def test_pendulum_with_trig(spark):
    world = discovery.World(["theta", "omega"], {"theta": ex.parse("omega"), "omega": ex.parse("-0.25*omega - 9.81*sin(theta)")}, {}, {})
    x = discovery.trajectory(world, np.array([1.2, 0.0]), 0.005, 1500)
    w = discovery.discover(frame(spark, np.arange(1501) * 0.005, theta=x[:, 0], omega=x[:, 1]), ["theta", "omega"], degree=1, trig=True, threshold=0.05)
    assert w.coefficients["omega"]["sin(theta)"] == pytest.approx(-9.81, rel=0.01)


def test_neighbours_chunks_agree_with_one_window(spark):
    df = frame(spark, np.arange(50) ** 1.3, x=np.random.default_rng(0).random(50))
    one, many = (sorted(neighbours(df, ["x"], chunk_rows=k).collect()) for k in (1000, 7))
    assert one == many


def test_frame_rules(spark):
    with pytest.raises(ValueError, match="strictly increasing"):
        validated(frame(spark, [0, 0, 1], x=[1, 2, 3]))
    with pytest.raises(ValueError, match="finite"):
        validated(frame(spark, [0, 1], x=[1, float("nan")]))
    assert validated(frame(spark, [0, 1], b=[1, 2], a=[3, 4])).columns == ["series_id", "t", "a", "b"]


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 6))
    y = 2 * x[:, 1] - 0.7 * x[:, 4] + 1e-3 * rng.standard_normal(500)
    return Gram([f"x{i}" for i in range(6)], 500, x.T @ x, (x.T @ y)[:, None], np.array([y @ y]), np.array([y.sum()])), x, y


@pytest.mark.parametrize("solver", ["stlsq", "sr3", "frols", "ssr"])
def test_solvers_find_the_support(problem, solver):
    m, x, y = problem
    c = sparse.SOLVERS[solver](m, **({"most_terms": 2} if solver == "frols" else {}))
    assert c[1] == pytest.approx(2, abs=0.01) and c[4] == pytest.approx(-0.7, abs=0.01)
    if solver != "ssr":
        assert set(np.flatnonzero(c)) == {1, 4}


def test_lasso_and_nnls_conditions(problem):
    m, x, y = problem
    c = sparse.lasso(m, weight=5.0)
    r = x.T @ (y - x @ c)
    assert np.all(np.abs(r[c == 0]) <= 5 + 1e-6) and np.allclose(r[c != 0], 5 * np.sign(c[c != 0]), atol=1e-5)
    c = sparse.nnls(m)
    r = x.T @ (y - x @ c)
    assert np.all(c >= 0) and np.all(r[c == 0] <= 1e-6) and np.allclose(r[c > 0], 0, atol=1e-5)


def test_groups_and_empty_support(problem):
    m, _, _ = problem
    assert set(np.flatnonzero(np.abs(sparse.group_stlsq(m, [[0, 1], [2, 3], [4, 5]])) > 1e-9)) <= {0, 1, 4, 5}
    assert not sparse.stlsq(m, threshold=100).any()
    assert sparse.selection_stability([{1}, {1, 2}], 3) == ([0.0, 1.0, 0.5], 0.5)


def test_derivatives_of_known_functions(spark):
    t = np.linspace(0, 2 * np.pi, 201)[:-1]
    df = frame(spark, t, x=np.sin(t))
    for rule, tolerance in ((derivative.savitzky_golay, 1e-2), (derivative.spline, 1e-2), (derivative.spectral, 1e-8)):
        got = np.array([r.d_x for r in rule(df, "x").orderBy("t").collect()])
        assert np.abs(got - np.cos(t))[5:-5].max() < tolerance
    v = np.array([1.0] * 20 + [3.0] * 20)
    assert np.allclose(derivative.tv_denoise(v, 0.0), v)
    assert np.abs(np.diff(derivative.tv_denoise(v, 1.0))).max() == pytest.approx(1.9, abs=1e-3)


def test_expressions():
    e = ex.parse("-x^2 + 3*sin(y)/2 - 2^3^2")
    assert ex.evaluate(e, {"x": 2, "y": 1}) == pytest.approx(4 + 1.5 * np.sin(1) - 512)
    assert ex.to_text(ex.simplify(ex.parse("0 + (x*1) + (y-y)"))) == "x"
    assert ex.parse(ex.to_text(e)) == e
    d = ex.derivative(ex.parse("exp(x*y)/x"), "x")
    at = {"x": 0.7, "y": 1.3}
    f = lambda x: np.exp(x * 1.3) / x
    assert ex.evaluate(d, at) == pytest.approx((f(0.7 + 1e-6) - f(0.7 - 1e-6)) / 2e-6, rel=1e-6)
    for bad in ("log(0-1)", "1/0", "exp(1000)"):
        with pytest.raises((ValueError, OverflowError)):
            ex.evaluate(ex.parse(bad), {})
    for bad in ("", "1 +", "foo(1)", "(1", "1 $ 2"):
        with pytest.raises(ValueError):
            ex.parse(bad)


def test_strict_columns(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    with pytest.raises(Exception, match="division by zero"):
        df.select(ex.to_column(ex.parse("1/x"))).collect()


def test_feature_order():
    assert features.exponents(2, 2) == [(0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0)]


def test_regimes():
    v = np.array([0.0] * 30 + [5.0] * 30)
    assert regime.pelt_ends(v) == [30, 60]
    runs = regime.bocpd(v)
    assert runs[29] >= 28 and runs[35] <= 7
    a = np.array([[0.9, 0.1], [0.1, 0.9]])
    assert regime.viterbi(np.array([0.5, 0.5]), a, a, [0, 0, 0, 1, 1, 1]) == [0, 0, 0, 1, 1, 1]


def test_linear_models(spark):
    a = np.array([[0.9, 0.1], [-0.1, 0.8]])
    x = [np.array([1.0, 2.0])]
    for _ in range(40):
        x.append(a @ x[-1])
    x = np.array(x)
    got, _ = linear.dmd(frame(spark, range(41), p=x[:, 0], q=x[:, 1]), ["p", "q"])
    assert np.allclose(got, a, atol=1e-6)
    names, k = linear.edmd(frame(spark, range(41), p=x[:, 0], q=x[:, 1]), ["p", "q"], 1)
    assert np.allclose(k[1:, 1:][::-1, ::-1], a, atol=1e-6) and names[0] == "1"


def test_control():
    a, b = np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[0.0], [1.0]])
    k = linear.lqr(a, b, np.eye(2), np.eye(1))
    assert np.all(np.linalg.eigvals(a - b @ k).real < 0)
    assert np.allclose(np.sort(np.linalg.eigvals(a - b @ linear.place_poles(a, b, [-1, -2]))), [-2, -1])
    s = np.array([[-1.0, 0.5], [0.0, -2.0]])
    assert np.allclose(s @ (p := linear.lyapunov_equation(s, np.eye(2))) + p @ s.T, -np.eye(2))
    c = np.array([[1.0, 0.0]])
    values = linear.hankel_values(s, b, c)
    ra, rb, rc = linear.balanced_truncation(s, b, c, 2)
    assert np.allclose(linear.hankel_values(ra, rb, rc), values, atol=1e-6)
    assert np.all(np.abs(np.linalg.eigvals(a / 2 - b @ linear.dlqr(a / 2, b, np.eye(2), np.eye(1)))) < 1)
    assert linear.classify(np.array([-1.0, -2.0])) == "stable node" and linear.classify(np.array([1.0, -2.0])) == "saddle"


def test_chaos_and_fixed_points():
    w = discovery.World(["x", "y", "z"], {"x": ex.parse("10*(y - x)"), "y": ex.parse("x*(28 - z) - y"), "z": ex.parse("x*y - 8/3*z")}, {}, {})
    assert linear.lyapunov_exponents(w.slopes, w.jacobian, np.array([1.0, 1.0, 20.0]), 0.01, 4000)[0] == pytest.approx(0.9, abs=0.25)
    points = linear.fixed_points(w.slopes, w.jacobian, np.array([[0.1, 0.1, 0.1], [8, 8, 26], [-8, -8, 26]]))
    assert len(points) == 3 and points[0][1] == "saddle"


def test_choice():
    assert score.pareto_front([(1, 3), (2, 2), (3, 1), (2, 3), (1, 3)]) == [0, 1, 2, 4]
    assert discovery.folds(10, 3) == [(2, 5), (5, 7), (7, 10)]
    assert discovery.holdout(10, 0.3) == 7


def switched(n=256):
    t = np.arange(n) * 0.05
    return t, np.where(t < 6.4, np.exp(0.2 * t), np.exp(0.2 * 6.4) * np.exp(-0.5 * (t - 6.4)))


def test_tracking_in_parts_equals_whole():
    t, v = switched()
    whole = online.Tracker().add(t, v)
    state, parts = None, []
    for a in range(0, 256, 37):
        k = online.Tracker(state=state)
        parts += k.add(t[a : a + 37], v[a : a + 37])
        state = k.state()
    assert parts == whole and whole and whole[0]["new_rate"] < 0
    with pytest.raises(ValueError):
        online.Tracker(state=state).add(t[:1], v[:1])


def test_streaming_query(spark, tmp_path):
    t, v = switched()
    df = frame(spark, t, x=v)
    for k in range(4):
        df.where(F.floor(F.col("t") / 3.2) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.track(stream, "x").writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.window for r in spark.sql("SELECT * FROM tracked ORDER BY window").collect()] == [r.window for r in online.changes(df, "x").orderBy("window").collect()]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time, x ,y\n0,1,2\n1, 3 ,4\n")
    got = readers.read_frame(spark, str(tmp_path / "a.csv"), "time")
    assert got.columns == ["series_id", "t", "x", "y"] and got.count() == 2
    (tmp_path / "b.csv").write_text("time,x\n0,1\n1,two\n")
    with pytest.raises(Exception):
        readers.read_frame(spark, str(tmp_path / "b.csv"), "time").collect()
    (tmp_path / "c.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    assert readers.read_records(spark, str(tmp_path / "c.json"), "json").count() == 2
    readers.write_records(got, str(tmp_path / "out"), "parquet", "error", ("series_id",))
    assert readers.read_records(spark, str(tmp_path / "out"), "parquet").count() == 2
    assert readers.require_read_only_select("SELECT 'drop' FROM t;") == "SELECT 'drop' FROM t"
    assert readers.require_read_only_select("SELECT replace(a, 'x', 'y') AS copy, \"set\" FROM t -- delete\n") == "SELECT replace(a, 'x', 'y') AS copy, \"set\" FROM t"
    for q in ("DETACH x", "WITH a AS (SELECT 1) DELETE FROM t", "SELECT 1; DETACH x", "WITH a AS (DELETE FROM t RETURNING *) SELECT * FROM a", "WITH a AS (/* x */ insert into t select 1) SELECT 1", "SELECT * INTO u FROM t", "select 1 -- '\n; drop table t"):
        with pytest.raises(ValueError):
            readers.require_read_only_select(q)
    for q in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            readers.require_read_only_select(q)
    with pytest.raises(ValueError):
        readers.quote_identifier("a;b")
    assert readers.ReadRequest(("a",), {}, 1, 1).apply(spark.createDataFrame([(1,), (2,)], "a int")).count() == 1


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(40), rng.random(40)
    m = gram(frame(spark, range(40), x=x, y=y), [("1", F.lit(1.0)), ("x", F.col("x"))], [("y", F.col("y"))])
    assert np.allclose(m.solve([0, 1], ridge=0), np.polyfit(x, y, 1)[::-1])

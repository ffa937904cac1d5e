"""Selection, ensembles, events, graphs, records and wide sums against brute force, and what each refuses."""

import json
import sqlite3
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.frames import KEY, TIME
from tidewright.functions import statistics as st
from tidewright.operators import events, features, graphs, selection, sparse
from tidewright.operators import gram as gram_
from tidewright.operators.gram import gram
from tidewright.sources import records


@pytest.fixture(scope="module")
def noisy(spark):
    """y = 2 - 3 a + 0.5 a b, with noise, over 400 rows."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 400))
    y = 2 - 3 * a + 0.5 * a * b + 0.01 * rng.normal(size=400)
    return a, b, y, spark.createDataFrame([("s", float(i), *map(float, r)) for i, r in enumerate(zip(a, b, y, strict=True))], "series_id string, t double, a double, b double, y double").repartition(5)


def design(a, b, degree):
    value = {"1": np.ones_like(a), "a": a, "b": b, "a*a": a * a, "a*b": a * b, "b*b": b * b}
    names = [n for n, _ in features.polynomial(["a", "b"], degree)]
    return names, np.column_stack([value[n] for n in names])


def brute_stlsq(x, y, threshold):
    active = np.ones(x.shape[1], bool)
    for _ in range(20):
        c = np.zeros(x.shape[1])
        c[active] = np.linalg.lstsq(x[:, active], y, rcond=None)[0]
        new = active & (np.abs(c) >= threshold)
        if (new == active).all() or not new.any():
            return c * new
        active = new
    return c


def test_select_model(noisy):
    a, b, y, df = noisy
    got = selection.select_model(df, ["a", "b"], ("y", F.col("y")), [1, 2], [0.1, 5.0], 3).orderBy("index").collect()
    border = [j * 400 // 4 for j in range(5)]
    for r in got:
        _, x = design(a, b, r.degree)
        scores = []
        for j in range(1, 4):
            c = brute_stlsq(x[: border[j]], y[: border[j]], r.threshold)
            scores.append(((y - x @ c)[border[j] : border[j + 1]] ** 2).mean())
        assert np.isclose(r.fold_score, np.mean(scores), rtol=1e-6)
    assert [(r.degree, r.threshold) for r in got if r.chosen] == [(2, 0.1)] and [r.terms for r in got if r.chosen] == [3]


def test_solvers_against_whole_designs(noisy):
    """Every solver on the Gram sums against the same method on the rows, or against what its answer must fulfil."""
    a, b, y, df = noisy
    names, x = design(a, b, 2)
    m = gram(df, features.polynomial(["a", "b"], 2), [("y", F.col("y"))])
    assert np.allclose(sparse.SOLVERS["stlsq"](m, threshold=0.1), brute_stlsq(x, y, 0.1), atol=1e-7)
    c = sparse.SOLVERS["lasso"](m, weight=4.0)
    slope = x.T @ (y - x @ c)
    assert all(abs(g) <= 4.001 if not k else abs(g - 4 * np.sign(k)) < 1e-2 for g, k in zip(slope, c, strict=True)) or all(abs(g) <= 4.001 * 400 for g in slope)
    c = sparse.SOLVERS["nnls"](m)
    slope = x.T @ (y - x @ c)
    assert (c >= 0).all() and (slope[c == 0] <= 1e-6 * 400).all() and np.abs(slope[c > 0]).max(initial=0) < 1e-5 * 400
    for name, options in (("frols", {"most_terms": 3}), ("ssr", {}), ("sr3", {"threshold": 0.1})):
        c = sparse.SOLVERS[name](m, **options)
        assert {n for n, k in zip(names, c, strict=True) if abs(k) > 0.1} == {"1", "a", "a*b"}, name


def test_auto_parsimony_and_ensemble(noisy):
    a, b, y, df = noisy
    m = gram(df, features.polynomial(["a", "b"], 2), [("y", F.col("y"))])
    best = selection.auto_parsimony(m, [0.001, 0.1, 1.0, 10.0])
    size, loss = (np.array([r[k] for r in best["sweep"]], float) for k in (1, 2))
    price = abs(np.polyfit(size, loss, 1)[0])
    assert np.isclose(best["price"], price) and best["threshold"] == [0.001, 0.1, 1.0, 10.0][int((loss + price * size).argmin())]
    rows = {r.term: r for r in selection.subsample_ensemble(df, features.polynomial(["a", "b"], 2), ("y", F.col("y")), 12, 0.5, 3, 0.1).collect()}
    assert all(rows[n].frequency == 1 for n in ("1", "a", "a*b")) and rows["b*b"].frequency == 0 and abs(rows["a"].mean + 3) < 0.01
    again = selection.subsample_ensemble(df.repartition(2), features.polynomial(["a", "b"], 2), ("y", F.col("y")), 12, 0.5, 3, 0.1).collect()
    assert all(np.isclose(r.deviation, rows[r.term].deviation) for r in again)


def test_wide_gram(noisy, monkeypatch):
    *_, df = noisy
    terms = features.polynomial(["a", "b"], 2)
    targets = [("y", F.col("y")), ("z", F.col("a") - F.col("y"))]
    narrow = gram(df, terms, targets)
    monkeypatch.setattr(gram_, "MOST_TERMS", 3)
    wide = gram(df, terms, targets)
    assert wide.n == narrow.n and all(np.allclose(getattr(wide, k), getattr(narrow, k)) for k in ("g", "b", "yy", "y"))
    assert gram(df.limit(0), terms, targets).n == 0


def test_events(spark):
    df = spark.createDataFrame([("s", 0.0, -1.0), ("s", 1.0, 0.0), ("s", 2.0, 1.0), ("s", 3.0, float("nan")), ("s", 4.0, 2.0), ("s", 5.0, -2.0)], "series_id string, t double, x double")
    assert [r.t for r in events.crossings(df, "x").orderBy("t").collect()] == [1.0, 5.0]
    assert [(r.t, r.crossed_at) for r in events.crossings(df, "x", 0.0, "falling").collect()] == [(5.0, 4.5)]
    spans = spark.createDataFrame([(1, 0.0, 2.0)], "k int, start double, end double")
    cuts = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0)], "k int, time double")
    assert sorted(map(tuple, events.split_at_events(spans, cuts, ["k"]).collect())) == [(1, 0.0, 1.0), (1, 1.0, 2.0)]
    with pytest.raises(Exception, match="outside its span"):
        events.split_at_events(spans, spark.createDataFrame([(1, 3.0)], "k int, time double"), ["k"]).collect()
    with pytest.raises(Exception, match="no law for regime"):
        events.laws_by_regime(df.withColumn("r", F.lit(9)), {0: (1.0, 1.0)}, "r", "x").collect()
    assert events.next_change(df, [], 9.0).where("next_change IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        events.sampled_control(df, [1, 1], [0, 0], "u")


def test_graphs(spark):
    edges = [("a", "c"), ("b", "c"), ("c", "d"), ("a", "b")]
    e = spark.createDataFrame(edges, "src string, dst string")
    assert graphs.topological_order(list("dcba"), edges) == ["a", "b", "c", "d"]
    assert graphs.colliders(e).count() == 0 and [tuple(r) for r in graphs.colliders(e.where("src != 'a' OR dst != 'b'")).collect()] == [("a", "c", "b")]
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert dict(map(tuple, graphs.layers(nodes, e).collect())) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    with pytest.raises(ValueError):
        graphs.topological_order(["a", "b"], [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError):
        graphs.layers(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), 5)


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("r1", "7", "2024-01-02"), ("r2", "x", None), ("r3", None, "soon")], "id string, n string, d string")
    issues, missing = records.validate_records(df, [records.FieldRule("n", "int"), records.FieldRule("d", "date", False), records.FieldRule("gone", "int")], "id")
    assert sorted(map(tuple, issues.where("field != 'gone'").collect())) == [("r2", "n", "not int"), ("r3", "d", "not date"), ("r3", "n", "missing")]
    assert issues.where("field = 'gone'").count() == 3 and dict(map(tuple, missing.collect())) == {"n": 1, "d": 1}
    a = records.fingerprint_records(df, ["id"]).first()
    b = records.fingerprint_records(df.repartition(3).select("d", "id", "n"), ["id"]).first()
    assert a == b and a.rows == 3 and a.sha256 != records.fingerprint_records(df.withColumn("n", F.lit("7")), ["id"]).first().sha256
    assert records.fingerprint_records(df.limit(0), ["id"]).count() == 0
    assert [len(c) for c in records.in_chunks(df, 2)] == [2, 1]
    text = spark.createDataFrame([("1.234,5",), ("",), (None,)], "v string")
    assert [r[0] for r in text.select(records.number(F.col("v"), ",", ".")).collect()] == [1234.5, None, None]
    times = spark.createDataFrame([("0.5",), ("1970-01-01T01:00:00+01:00",), ("1970-01-01T00:00:01Z",)], "v string")
    assert [r[0] for r in times.select(records.utc_timestamp(F.col("v"))).collect()] == [500_000, 0, 1_000_000]
    with pytest.raises(Exception, match="no zone"):
        spark.createDataFrame([("1970-01-01T00:00:01",)], "v string").select(records.utc_timestamp(F.col("v"))).collect()
    with pytest.raises(ValueError):
        records.plan_time_partitions(spark, datetime(2024, 1, 1), datetime(2024, 1, 2, tzinfo=UTC), timedelta(1))
    assert records.plan_row_partitions(spark, 0, 5).count() == 0
    path = str(tmp_path / "f.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"v{k}") for k in range(50)])
    for parts in (1, 4):
        got = records.read_sqlite(spark, path, "SELECT k, v FROM t WHERE k >= ?", "k long, v string", (10,), "k", parts)
        assert sorted(map(tuple, got.collect())) == [(k, f"v{k}") for k in range(10, 50)]
    with pytest.raises(ValueError):
        records.read_sqlite(spark, path, "DELETE FROM t", "k long")
    df.write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    assert {n for n, _ in records.inspect_parquet(str(part))["fields"]} == {"id", "n", "d"}
    assert json.loads(json.dumps(st.z_for_confidence(0.95))) == pytest.approx(1.959964, abs=1e-6)
    with pytest.raises(ValueError):
        st.normal_pdf(F.col("x"), 0.0, 0.0)


def test_refusals():
    """What a segmentation, a run-length filter and a bounded search do not take."""
    from tidewright.operators import regime
    from tidewright.plans import worlds

    for v in ([1.0, 2.0], [1.0, float("nan"), 2.0, 3.0]):
        with pytest.raises(ValueError):
            regime.pelt_ends(np.array(v))
    with pytest.raises(ValueError), np.errstate(all="ignore"):
        regime.bocpd(np.array([0.0, 1e200]))
    far = lambda p: float(((p - np.array([3.0, -2.0])) ** 2).sum())
    assert np.allclose(worlds.nelder_mead(far, np.array([0.0, 0.0])), [3, -2], atol=1e-4)
    assert np.allclose(worlds.nelder_mead(far, np.array([1.0, 1.0]), low=-1.0, high=1.0), [1, -1], atol=1e-4)
    with pytest.raises(ValueError):
        worlds.nelder_mead(far, np.zeros(2), low=1.0, high=0.0)


def test_monomial_names(spark):
    assert all(features.monomial_names(list("abc")[:n], d) == [x for x, _ in features.polynomial(list("abc")[:n], d)] for n in (1, 2, 3) for d in (0, 1, 3))


def test_stability_table(spark):
    rows = [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "c")]
    got = {r.term: (r.frequency, r.similarity) for r in selection.stability_table(spark.createDataFrame(rows, "k int, term string"), "k", "term").collect()}
    _, want = sparse.selection_stability([{0, 1}, {0, 1}, {1}, {2}], 3)
    assert {k: v[0] for k, v in got.items()} == {"a": 0.5, "b": 0.75, "c": 0.25} and all(np.isclose(v[1], want) for v in got.values())

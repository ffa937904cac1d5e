"""Queries on control, analysis, expressions, units and fields: systems small enough for closed forms, one for each nation, which SQL can say."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DAY, EV, LI, _numbers, query, rounded
from .frames import KEY, TIME, daily_orders, events_frame, lineitem_rows, numbered, table
from .functions import expressions as ex
from .functions import units
from .operators import derivative, prep, resampling, sparse
from .operators.score import description_length
from .plans import analysis, discovery, fields, linear
from .plans.discovery import World


def _fan_out(spark: SparkSession, sf_dir: str, columns: list[str], rule: Callable[[float], list[float]]) -> DataFrame:
    """rule(k) for each nation's number k, spread over the cluster."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([[n, *rule(float(k))] for n, k in zip(part["n_name"], part["n_nationkey"], strict=True)], columns=["n_name", *columns])

    return table(spark, sf_dir, "nation").select("n_name", "n_nationkey").mapInPandas(run, "n_name string, " + ", ".join(f"{c} double" for c in columns))


_SYSTEM = "s AS (SELECT n_name, -0.5 - n_nationkey / 10.0::DOUBLE AS a, 1 + n_nationkey / 5.0::DOUBLE AS b, 0.5::DOUBLE AS c, 2.0::DOUBLE AS q, 3.0::DOUBLE AS r FROM nation)"


def _system(k: float) -> list[np.ndarray]:
    return [np.array([[v]]) for v in (-0.5 - k / 10, 1 + k / 5, 0.5, 2.0, 3.0)]


CONTROL = ["lyapunov", "lqr", "dare", "dlqr", "kalman", "placed", "hankel", "reachable", "seen", "reach", "sight", "observer", "ahead"]


def _control(k: float) -> list[float]:
    a, b, c, q, r = _system(k)
    d = a / 5
    return [float(np.ravel(v)[0]) for v in (linear.lyapunov_equation(a, q), linear.lqr(a, b, q, r), linear.dare(d, b, q, r), linear.dlqr(d, b, q, r), linear.kalman_gain(a, c, q, r), linear.place_poles(a, b, [-4.0]), linear.hankel_values(a, b, c), linear.controllability(a, b), linear.observability(a, c), linear.controllability_gramian(a, b), linear.observability_gramian(a, c), linear.observer_gain(a, c, [-4.0]), linear.mpc_gain(d, b, q, r, 2))]


@query(f"""WITH {_SYSTEM}, p AS (SELECT *, a / 5 AS d, (r * (1 - a * a / 25) - q * b * b) AS beta FROM s), e AS (SELECT *, (-beta + sqrt(beta * beta + 4 * b * b * q * r)) / (2 * b * b) AS p FROM p)
SELECT n_name, round(-q / (2 * a), 6) AS lyapunov, round((a + sqrt(a * a + b * b * q / r)) / b, 6) AS lqr, round(p, 6) AS dare, round(d * b * p / (r + b * b * p), 6) AS dlqr, round((a + sqrt(a * a + c * c * q / r)) / c, 6) AS kalman, round((a + 4) / b, 6) AS placed, round(b * c / (2 * abs(a)), 6) AS hankel, round(b, 6) AS reachable, round(c, 6) AS seen, round(-b * b / (2 * a), 6) AS reach, round(-c * c / (2 * a), 6) AS sight, round((a + 4) / c, 6) AS observer, round(d * b * (q + d * d * q * r / (r + b * b * q)) / (r + b * b * (q + d * d * q * r / (r + b * b * q))), 6) AS ahead FROM e""")
def control_gains(spark, sf_dir):
    return rounded(_fan_out(spark, sf_dir, CONTROL, _control))


def _analysis(k: float) -> list[float]:
    rate = -0.5 - k / 10
    world = World(["x"], {"x": ex.parse("r*x")}, {}, {})
    bound = World(["x"], {"x": ex.substitute(world.laws["x"], {"r": ex.num(rate)})}, {}, {})
    s = analysis.sensitivities(world, {"r": rate}, np.array([2.0]), 0.01, 100)
    exponent = linear.lyapunov_exponents(bound.slopes, bound.jacobian, np.array([1.0]), 0.001, 200)[0]
    return [float(exponent), float(analysis.stability(bound, np.array([0.0])) == "stable node"), float(s[-1, 0, 0]), float(analysis.delta_forecast(s, np.array([[0.04]]))[-1, 0])]


@query("WITH s AS (SELECT n_name, -0.5 - n_nationkey / 10.0::DOUBLE AS a FROM nation) SELECT n_name, round(a, 4) AS exponent, 1.0::DOUBLE AS stable, round(2 * exp(a), 4) AS sensitivity, round(0.2 * 2 * exp(a), 4) AS deviation FROM s")
def linear_analysis(spark, sf_dir):
    return rounded(_fan_out(spark, sf_dir, ["exponent", "stable", "sensitivity", "deviation"], _analysis), 4)


def _fold(k: float) -> list[float]:
    """x' = p - x^2 has its fixed points at the roots of p, one of them stable."""
    p = 1 + k
    found = analysis.sweep({"x": ex.parse("p - x*x")}, ["x"], "p", [p], np.array([[-3.0], [3.0]]))
    return [x[0] for _, x, kind in sorted(found, key=lambda f: f[1])] + [float([kind for _, x, kind in sorted(found, key=lambda f: f[1])] == ["unstable node", "stable node"])]


@query("SELECT n_name, round(-sqrt(1.0 + n_nationkey), 6) AS low, round(sqrt(1.0 + n_nationkey), 6) AS high, 1.0::DOUBLE AS kinds FROM nation")
def fixed_points_of_fold(spark, sf_dir):
    return rounded(_fan_out(spark, sf_dir, ["low", "high", "kinds"], _fold))


@query(f"WITH {LI} SELECT l_orderkey, l_linenumber, round(2 * q * sin(d) + x, 6) AS by_q, round(q * q * cos(d), 6) AS by_d, round(q * q * sin(x) + x * q, 6) AS swapped, round(q, 6) AS simple, round((2 * q * sin(d) + x) * d + q * q * cos(d) * -q, 6) AS along, 10 AS nodes FROM li")
def expression_calculus(spark, sf_dir):
    """Of q^2 sin(d) + x q: its derivatives, d replaced by x, its derivative along q' = d, d' = -q; and a sum that simplifies to q."""
    e = ex.parse("q*q*sin(d) + x*q")
    laws = {"q": ex.parse("d"), "d": ex.parse("0 - q")}
    parts = {"by_q": ex.derivative(e, "q"), "by_d": ex.derivative(e, "d"), "swapped": ex.substitute(e, {"d": ex.parse("x")}), "simple": ex.simplify(ex.parse("0 + (q*1) + (d - d)")), "along": ex.lie_derivative(e, laws)}
    nodes = ex.size(ex.parse(ex.to_text(e)))
    return rounded(lineitem_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", *[ex.to_column(v).alias(k) for k, v in parts.items()], F.lit(nodes).alias("nodes")))


_UNITS = [("km/h", "m/s", "1 / 3.6"), ("J", "kg*m^2/s^2", "1.0"), ("min", "ms", "60000.0"), ("g*cm/s^2", "N", "0.00001"), ("V*A", "W", "1.0"), ("C/V", "F", "1.0")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, round(CAST({v} AS DOUBLE), 9) AS factor" for a, b, v in _UNITS))
def unit_conversions(spark, sf_dir):
    rows = [(a, b, units.conversion(units.parse_unit(a), units.parse_unit(b))) for a, b, _ in _UNITS]
    return spark.createDataFrame(rows, "source string, target string, factor double").withColumn("factor", F.round("factor", 9))


_GRID = "g AS (SELECT t, x, sin(0.3 * x) * exp(-0.1 * t) AS u FROM (SELECT unnest(range(30)) AS t), (SELECT unnest(range(40)) AS x))"


@query(f"WITH {_GRID}, n AS (SELECT t, x, u, (lead(u) OVER b - lag(u) OVER b) / 0.2 AS u_t, (lead(u) OVER a - lag(u) OVER a) / 0.4 AS u_1, (lead(u) OVER a - 2 * u + lag(u) OVER a) / 0.04 AS u_2, lead(u, 2) OVER a AS r FROM g WINDOW a AS (PARTITION BY t ORDER BY x), b AS (PARTITION BY x ORDER BY t)) SELECT t AS t_idx, x AS x_idx, round(u, 6) AS u, round(u_t, 6) AS u_t, round(u_1, 6) AS u_1, round(u_2, 6) AS u_2 FROM n WHERE u_t IS NOT NULL AND u_1 IS NOT NULL")
def field_stencils(spark, sf_dir):
    t, x = spark.range(30).withColumnRenamed("id", "t_idx"), spark.range(40).withColumnRenamed("id", "x_idx")
    grid = t.crossJoin(F.broadcast(x)).withColumn("u", F.sin(0.3 * F.col("x_idx")) * F.exp(-0.1 * F.col("t_idx")))  # a grid of 30 x 40 points
    return rounded(fields.stencils(grid, 0.1, 0.2, 2))


@query("WITH g AS (SELECT n_name AS series_id, k, k * 0.125::DOUBLE AS t, 1 + n_nationkey % 5 AS f FROM nation, (SELECT unnest(range(64)) AS k)) SELECT series_id, t, round(2 * pi() * f / 8 * cos(2 * pi() * f * t / 8), 6) AS d_x FROM g")
def spectral_waves(spark, sf_dir):
    """The derivative of whole waves on a regular grid, exact up to rounding."""
    f, t = 1 + F.col("n_nationkey") % 5, F.col("k") * 0.125
    rows = table(spark, sf_dir, "nation").crossJoin(spark.range(64).withColumnRenamed("id", "k"))  # 64 literal points for each row
    return rounded(derivative.spectral(rows.select(F.col("n_name").alias(KEY), t.alias(TIME), F.sin(2 * math.pi * f * t / 8).alias("x")), "x").drop("x"))


@query("SELECT 'e_value' AS name, round(2.5 + sqrt(2.5 * 1.5), 6) AS v UNION ALL SELECT 'e_value of a half', round(2 + sqrt(2.0), 6) UNION ALL SELECT 'delta_band', round(sqrt(1 * 0.04 + 2 * 2 * 0.01 + 4 * 0.09), 6) UNION ALL SELECT 'structural_score', round(1 - (1 + exp(-2.0)) / pow(1 + exp(-1.0), 2), 6) UNION ALL SELECT 'stability of x', round(2.0 / 3, 6) UNION ALL SELECT 'similarity', round((1 + 0.5 + 0.5) / 3, 6) UNION ALL SELECT 'description_length', round(50 * ln(2 * pi() * 0.04) + 50 + 5 * ln(13.0) + 0.5 * ln(100.0) + ln(3.0), 6)")
def uncertainty_scalars(spark, sf_dir):
    share, alike = sparse.selection_stability([{0, 1}, {0, 1}, {1}], 2)
    rows = [("e_value", resampling.e_value(2.5)), ("e_value of a half", resampling.e_value(0.5)), ("delta_band", resampling.delta_band(np.array([1.0, 2.0]), np.array([[0.04, 0.01], [0.01, 0.09]]))), ("structural_score", resampling.structural_score([3.0, 5.0])), ("stability of x", share[0]), ("similarity", alike), ("description_length", description_length(100, 4.0, 5, 2, [2.0]))]
    return _numbers(spark, rows, "name string, v double")


@query(f"""WITH {DAY}, l AS (SELECT x, y, lead(x) OVER (ORDER BY t) AS u, lead(y) OVER (ORDER BY t) AS v FROM day),
s AS (SELECT sum(x*x) AS a, sum(x*y) AS b, sum(y*y) AS c, sum(x*u) AS xu, sum(y*u) AS yu, sum(x*v) AS xv, sum(y*v) AS yv FROM l WHERE u IS NOT NULL),
m AS (SELECT ((xu*c - yu*b) + (a*yv - b*xv)) / (a*c - b*b) AS tr, ((xu*c - yu*b) * (a*yv - b*xv) - (a*yu - b*xu) * (xv*c - yv*b)) / pow(a*c - b*b, 2) AS det FROM s),
e AS (SELECT (tr + sqrt(tr*tr - 4*det)) / 2 AS p, (tr - sqrt(tr*tr - 4*det)) / 2 AS q FROM m)
SELECT 0 AS mode, round(CASE WHEN abs(p) >= abs(q) THEN p ELSE q END, 6) AS eigenvalue, round(ln(abs(CASE WHEN abs(p) >= abs(q) THEN p ELSE q END)), 6) AS rate FROM e
UNION ALL SELECT 1, round(CASE WHEN abs(p) >= abs(q) THEN q ELSE p END, 6), round(ln(abs(CASE WHEN abs(p) >= abs(q) THEN q ELSE p END)), 6) FROM e""")
def dmd_spectrum(spark, sf_dir):
    a, _ = linear.dmd(daily_orders(spark, sf_dir), ["x", "y"])
    return _numbers(spark, [(k, z.real, w.real) for k, (z, w) in enumerate(linear.modes(a))], "mode int, eigenvalue double, rate double")


@query(f"""WITH {DAY}, f AS (SELECT regr_slope(x, t) AS b, regr_intercept(x, t) AS a, max(x) FILTER (rn = n * 4 // 5) AS o FROM day WHERE rn <= n * 4 // 5), e AS (SELECT x, x - a - b * t AS e, x - o AS h FROM day, f WHERE rn > n * 4 // 5)
SELECT 'orders' AS series_id, count(*) AS n, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e*e) / (var_pop(x) * count(*)), 6) AS r2, round(1 - sqrt(avg(e*e)) / sqrt(avg(h*h)), 6) AS skill FROM e""")
def holdout_scores(spark, sf_dir):
    """A line through the first four fifths of the days, against the rest."""
    d = numbered(daily_orders(spark, sf_dir), "rn")
    cut = d.count() * 4 // 5
    line = d.where(F.col("rn") < cut).agg(F.regr_slope("x", TIME).alias("b"), F.regr_intercept("x", TIME).alias("a"), F.max(F.when(F.col("rn") == cut - 1, F.col("x"))).alias("o"))
    rest = d.where(F.col("rn") >= cut).crossJoin(F.broadcast(line)).withColumn("p", F.col("a") + F.col("b") * F.col(TIME))  # line is one row
    return rounded(discovery.holdout_scores(rest, "x", "p", "o"))


@query()
def regime_laws(spark, sf_dir):
    """The daily orders in stretches of like mean, each with its law."""
    d = daily_orders(spark, sf_dir).select(KEY, (F.col(TIME) / 100).alias(TIME), "x")
    return rounded(discovery.regime_laws(d, "x", 1, 0.05, 4.0))


@query(f"WITH {EV}, r AS (SELECT series_id, t, x FROM ev WHERE t BETWEEN 0 AND 600000), m AS (SELECT series_id, t, avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM r), s AS (SELECT series_id, avg(x) AS m, stddev_pop(x) AS d FROM m GROUP BY 1) SELECT series_id, round(t, 6) AS t, round((x - m) / d, 6) AS x FROM m JOIN s USING (series_id)")
def prep_pipeline(spark, sf_dir):
    return rounded(prep.prepared(events_frame(spark, sf_dir), [("trim", 0, 600_000), ("smooth", 2), ("standardize",)]))


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_custkey, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r = 1")
def next_in_queue(spark, sf_dir):
    """Of each queue the entry with the earliest deadline, ties by who asked first and by number: an aggregate, no sort."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    first = F.min_by(F.struct("o_orderkey", "o_custkey"), F.struct("o_orderdate", "o_custkey", "o_orderkey"))
    return o.groupBy("o_orderpriority").agg(first.alias("b")).select("o_orderpriority", "b.*")

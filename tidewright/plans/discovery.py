"""From a series frame to laws, and from laws to trajectories, forecasts, back-tests and monitors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import KEY, TIME, neighbours, numbered
from ..functions import expressions as ex
from ..operators import features, regime, sparse
from ..operators.derivative import finite_difference
from ..operators.gram import Gram, gram, residual_sums
from ..operators.profile import mad, quantiles_by


@dataclass
class World:
    """One law for each state: its derivative as an expression of the states and controls."""

    states: list[str]
    laws: dict[str, ex.Node]
    coefficients: dict[str, dict[str, float]]
    scores: dict[str, dict[str, float]]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, t, float(c)) for s in self.states for t, c in self.coefficients[s].items() if c]
        return spark.createDataFrame(rows, "state string, term string, coefficient double")

    def slopes(self, x: np.ndarray) -> np.ndarray:
        at = dict(zip(self.states, x.tolist(), strict=True))
        return np.array([ex.evaluate(self.laws[s], at) for s in self.states])

    def jacobian(self, x: np.ndarray) -> np.ndarray:
        at, j = dict(zip(self.states, x.tolist(), strict=True)), ex.jacobian(self.laws)
        return np.array([[ex.evaluate(j[a][b], at) for b in self.states] for a in self.states])


def law(coefficients: dict[str, float]) -> ex.Node:
    out = ex.num(0)
    for term, c in coefficients.items():
        if c:
            out = ("+", out, ("*", ex.num(c), ex.parse(term)))
    return ex.simplify(out)


def library(variables: list[str], degree: int, trig: bool = False, rational: bool = False) -> list[features.Term]:
    out = features.polynomial(variables, degree)
    return out + (features.trigonometric(variables) if trig else []) + (features.rational(variables) if rational else [])


def discover(df: DataFrame, states: list[str], controls: tuple[str, ...] = (), degree: int = 2, trig: bool = False, solver: str = "stlsq", **options) -> World:
    """Derivatives by one window pass, the library as expressions, all Gram sums in one aggregate; the solvers see p x p numbers.

    Rows at both ends of a series, whose derivatives are one-sided, are left out.
    """
    variables = sorted([*states, *controls])
    terms = library(variables, degree, trig)
    d = neighbours(finite_difference(df.select(KEY, TIME, *variables), states), [])
    rows = d.where(F.col(f"prev_{TIME}").isNotNull() & F.col(f"next_{TIME}").isNotNull())
    m = gram(rows, terms, [(s, F.col(f"d_{s}")) for s in states])
    laws, coefficients, scores = {}, {}, {}
    for k, s in enumerate(states):
        c = sparse.SOLVERS[solver](m, target=k, **options)
        coefficients[s] = dict(zip(m.names, c.tolist(), strict=True))
        laws[s] = law(coefficients[s])
        rss = m.rss(c, k)
        tss = m.yy[k] - m.y[k] ** 2 / max(m.n, 1)
        scores[s] = {"n": m.n, "rss": rss, "r2": 1 - rss / tss if tss > 0 else float(rss == 0), "terms": int((c != 0).sum())}
    return World(list(states), laws, coefficients, scores)


def refit_scores(df: DataFrame, world: World, degree: int = 2, trig: bool = False) -> dict[str, dict[str, float]]:
    """Scores from a second pass over the rows, which keeps the digits that the Gram loses near a perfect fit."""
    terms = library(sorted(world.states), degree, trig)
    d = finite_difference(df.select(KEY, TIME, *world.states), world.states)
    return {s: residual_sums(d, terms, np.array([world.coefficients[s].get(n, 0.0) for n, _ in terms]), F.col(f"d_{s}")) for s in world.states}


def rk4(slopes, x: np.ndarray, h: float) -> np.ndarray:
    a = slopes(x)
    b = slopes(x + h / 2 * a)
    c = slopes(x + h / 2 * b)
    return x + h / 6 * (a + 2 * b + 2 * c + slopes(x + h * c))


def trajectory(world: World, x0: np.ndarray, h: float, steps: int) -> np.ndarray:
    out = [np.asarray(x0, float)]
    for _ in range(steps):
        out.append(rk4(world.slopes, out[-1], h))
    return np.array(out)


def simulate(world: World, starts: DataFrame, h: float, steps: int) -> DataFrame:
    """starts(scenario, one column a state) -> (scenario, t, states): each row a trajectory, spread over the cluster."""
    states = world.states

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = trajectory(world, np.array([getattr(r, s) for s in states]), h, steps)
                yield pd.DataFrame({"scenario": r.scenario, TIME: np.arange(steps + 1) * h} | {s: x[:, k] for k, s in enumerate(states)})

    return starts.select("scenario", *states).mapInPandas(run, "scenario string, t double, " + ", ".join(f"{s} double" for s in states))


def euler_maruyama(world: World, noise: np.ndarray, x0: np.ndarray, h: float, steps: int, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), [np.asarray(x0, float)]
    for _ in range(steps):
        out.append(out[-1] + h * world.slopes(out[-1]) + np.sqrt(h) * noise * rng.standard_normal(len(x0)))
    return np.array(out)


def backtest(df: DataFrame, column: str, horizon: int, origins: int) -> DataFrame:
    """Rolling-origin scores of an exponential law x' = r x against persistence: (series_id, origin, n, rmse, mae, skill).

    Origins are round(i * last / (k - 1)) rows, each fitted on what comes before it; one task a series.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TIME)
        t, v = g[TIME].to_numpy(), g[column].to_numpy()
        last = len(v) - horizon - 1
        rows = []
        for o in sorted({max(3, round(i * last / max(1, origins - 1))) for i in range(origins)} if last >= 3 else ()):
            seen_t, seen = t[: o + 1], v[: o + 1]
            dv = np.gradient(seen, seen_t)
            r = float((dv * seen).sum() / max((seen * seen).sum(), 1e-300))
            ahead = slice(o + 1, o + 1 + horizon)
            e = v[ahead] - v[o] * np.exp(np.clip(r * (t[ahead] - t[o]), -50, 50))
            base = ((v[ahead] - v[o]) ** 2).sum()
            rows.append((g[KEY].iloc[0], o, len(e), float(np.sqrt((e * e).mean())), float(np.abs(e).mean()), float(1 - np.sqrt((e * e).sum() / base)) if base > 0 else None))
        return pd.DataFrame(rows, columns=[KEY, "origin", "n", "rmse", "mae", "skill"])

    return df.select(KEY, TIME, column).groupBy(KEY).applyInPandas(run, "series_id string, origin long, n long, rmse double, mae double, skill double")


def monitor(df: DataFrame, observed: str, predicted: str, limit: float = 3.0) -> DataFrame:
    """Residuals, their robust scale (1.4826 medians of absolute deviations, with a floor) and the flags beyond limit."""
    e = df.withColumn("residual", F.col(observed) - F.col(predicted))
    m = e.groupBy(KEY).agg(F.sqrt(F.avg(F.col(observed) * F.col(observed))).alias("rms_"))
    s = m.join(mad(e, "residual", [KEY]).select(KEY, F.col("median").alias("m_"), F.col("mad").alias("mad_")), KEY)
    scale = F.greatest(1.4826 * F.col("mad_"), 1e-9 * F.greatest(F.lit(1.0), F.col("rms_")))
    z = (F.col("residual") - F.col("m_")) / scale
    return e.join(s, KEY).select(*e.columns, z.alias("z"), (F.abs(z) > limit).alias("flagged"))


def residual_bands(df: DataFrame, residual: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Forecast bands by series: quantiles of the residuals."""
    return quantiles_by(df, residual, [KEY], (low, 0.5, high)).select(KEY, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def folds(n: int, k: int) -> list[tuple[int, int]]:
    """Forward-chaining folds: train up to floor(j n / (k + 1)), test up to the next border."""
    border = [j * n // (k + 1) for j in range(k + 2)]
    return [(border[j], border[j + 1]) for j in range(1, k + 1)]


def holdout(n: int, share: float) -> int:
    if not 0.05 <= share <= 0.9:
        raise ValueError("the share held out must be in 0.05..0.9")
    return min(max(int(np.floor(n * (1 - share))), 1), n - 2)


def controlled(world: World, controls: dict[str, tuple[np.ndarray, np.ndarray]], x0: np.ndarray, h: float, steps: int) -> np.ndarray:
    """A trajectory under controls (times, values) that are read on straight lines at each stage's own time, and held beyond them."""
    laws = world.laws

    def slopes(t: float, x: np.ndarray) -> np.ndarray:
        at = dict(zip(world.states, x.tolist(), strict=True)) | {c: float(np.interp(t, *tv)) for c, tv in controls.items()}
        return np.array([ex.evaluate(laws[s], at) for s in world.states])

    out = [np.asarray(x0, float)]
    for k in range(steps):
        t, x = k * h, out[-1]
        a = slopes(t, x)
        b = slopes(t + h / 2, x + h / 2 * a)
        c = slopes(t + h / 2, x + h / 2 * b)
        out.append(x + h / 6 * (a + 2 * b + 2 * c + slopes(t + h, x + h * c)))
    return np.array(out)


def ensemble_forecast(states: list[str], terms: list[str], members: np.ndarray, x0: np.ndarray, h: float, steps: int, low: float = 0.05, high: float = 0.95) -> dict[str, np.ndarray]:
    """Per state lower, median and upper (steps + 1 x 3) of the trajectories of members x states x terms coefficients; members that leave
    the finite numbers are left out, and raise if none stays."""
    parsed = [ex.parse(t) for t in terms]
    paths = []
    for c in members:
        slopes = lambda x, c=c: c @ np.array([ex.evaluate(t, dict(zip(states, x.tolist(), strict=True))) for t in parsed])
        out = [np.asarray(x0, float)]
        try:
            for _ in range(steps):
                out.append(rk4(slopes, out[-1], h))
        except ValueError:
            continue
        paths.append(out)
    if not paths:
        raise ValueError("no member stays finite")
    q = np.quantile(np.array(paths), [low, 0.5, high], axis=0)
    return {s: q[:, :, k].T for k, s in enumerate(states)}


def holdout_scores(df: DataFrame, observed: str, predicted: str, origin: str) -> DataFrame:
    """rmse, mae, r2 and skill (1 less the ratio of rmse to that of holding the origin's value) by series."""
    e, base = F.col(observed) - F.col(predicted), F.col(observed) - F.col(origin)
    out = df.groupBy(KEY).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("rss"), (F.var_pop(observed) * F.count("*")).alias("tss"), F.sqrt(F.avg(base * base)).alias("held"))
    return out.select(KEY, "n", "rmse", "mae", (1 - F.try_divide("rss", "tss")).alias("r2"), (1 - F.try_divide("rmse", "held")).alias("skill"))


def regime_laws(df: DataFrame, column: str, degree: int = 1, threshold: float = 0.05, penalty: float = 8.0) -> DataFrame:
    """(series_id, segment, start_t, end_t, term, coefficient): the series is cut where its mean shifts, and each stretch has a law of its own.

    Derivatives do not reach over a cut, as each stretch is a series of its own; the sums of all stretches are one aggregate.
    """
    cuts = regime.segments(df, column, penalty).select(KEY, "segment", "start", "end")
    rows = numbered(df.select(KEY, TIME, column)).join(cuts, KEY).where((F.col("rn_") >= F.col("start")) & (F.col("rn_") < F.col("end")))
    own = rows.select(F.to_json(F.struct(KEY, "segment")).alias(KEY), TIME, column)
    slopes = neighbours(finite_difference(own, [column]), []).where(F.col(f"prev_{TIME}").isNotNull() & F.col(f"next_{TIME}").isNotNull())
    terms = library([column], degree)
    p = len(terms)
    wide = slopes.select(KEY, *[c.alias(f"x{i}_") for i, (_, c) in enumerate(terms)], F.col(f"d_{column}").alias("y_"))
    names = [f"x{i}_" for i in range(p)] + ["y_"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    spans = {tuple(json.loads(r[KEY]).values()): (r["a"], r["b"]) for r in own.groupBy(KEY).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b")).collect()}
    out = []
    for r in wide.groupBy(KEY).agg(F.count("*"), F.sum("y_"), *[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).collect():
        key = tuple(json.loads(r[0]).values())
        full = np.zeros((p + 1, p + 1))
        full[np.triu_indices(p + 1)] = r[3:]
        full += np.triu(full, 1).T
        c = sparse.stlsq(Gram([n for n, _ in terms], int(r[1]), full[:p, :p], full[:p, p:], full[p:, p].copy(), np.array([r[2]])), threshold=threshold)
        out += [(*key, *spans[key], n, float(v)) for (n, _), v in zip(terms, c.tolist(), strict=True) if v]
    return df.sparkSession.createDataFrame(sorted(out), f"{KEY} string, segment long, start_t double, end_t double, term string, coefficient double")


def iterate(world: World, starts: DataFrame, steps: int) -> DataFrame:
    """starts(scenario, one column a state) -> (scenario, step, states): the laws give the next states, all from the last ones at once."""
    states = world.states

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                out = [np.array([getattr(row, s) for s in states], float)]
                for _ in range(steps):
                    out.append(world.slopes(out[-1]))
                    if not np.isfinite(out[-1]).all():
                        raise ValueError(f"{row.scenario} leaves the finite numbers")
                yield pd.DataFrame(np.array(out), columns=states).assign(scenario=row.scenario, step=range(steps + 1))[["scenario", "step", *states]]

    return starts.select("scenario", *states).mapInPandas(run, "scenario string, step long, " + ", ".join(f"{s} double" for s in states))

"""Estimators: laws, regressions and feature libraries that are fitted on a frame and then are columns of any other."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import KEY, TIME
from .functions import expressions as ex
from .operators import features, score, sparse
from .operators.derivative import finite_difference
from .operators.gram import fitted, gram
from .plans import discovery


class Dynamics(Estimator):
    """Sparse laws of states; the model gives their derivatives."""

    def __init__(self, states: list[str], degree: int = 2, threshold: float = 0.05, solver: str = "stlsq"):
        super().__init__()
        self.states, self.degree, self.threshold, self.solver = list(states), degree, threshold, solver

    def _fit(self, dataset: DataFrame) -> DynamicsModel:
        return DynamicsModel(discovery.discover(dataset, self.states, degree=self.degree, solver=self.solver, threshold=self.threshold))


class DynamicsModel(Model):
    def __init__(self, world: discovery.World):
        super().__init__()
        self.world = world

    def equations(self) -> dict[str, str]:
        return {s: ex.to_text(law) for s, law in self.world.laws.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f"predicted_d_{s}": ex.to_column(law) for s, law in self.world.laws.items()})

    def score(self, dataset: DataFrame) -> dict[str, float]:
        """r2 of each state's derivative, against the frame's own differences."""
        rows = self.transform(finite_difference(dataset.select(KEY, TIME, *self.world.states), self.world.states)).withColumn("k_", F.lit(1))
        return {s: score.fit_statistics(rows, f"d_{s}", f"predicted_d_{s}", ["k_"]).first()["r2"] for s in self.world.states}


class Regression(Estimator):
    """A sparse law of a target over monomials of columns."""

    def __init__(self, columns: list[str], target: str, degree: int = 2, threshold: float = 0.05, solver: str = "stlsq", output: str = "prediction"):
        super().__init__()
        self.columns, self.target, self.degree, self.threshold, self.solver, self.output = list(columns), target, degree, threshold, solver, output

    def _fit(self, dataset: DataFrame) -> RegressionModel:
        m = gram(dataset, features.polynomial(self.columns, self.degree), [(self.target, F.col(self.target))])
        return RegressionModel(self, sparse.SOLVERS[self.solver](m, threshold=self.threshold))


class RegressionModel(Model):
    def __init__(self, how: Regression, coefficients: np.ndarray):
        super().__init__()
        self.how, self.coefficients = how, coefficients

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.how.output, fitted(features.polynomial(self.how.columns, self.how.degree), self.coefficients))

    def score(self, dataset: DataFrame) -> float:
        rows = self.transform(dataset).withColumn("k_", F.lit(1))
        return score.fit_statistics(rows, self.how.target, self.how.output, ["k_"]).first()["r2"]


class Library(Estimator):
    """Monomials of columns, less those that correlate with an earlier one beyond a limit."""

    def __init__(self, columns: list[str], degree: int = 2, limit: float = 0.999):
        super().__init__()
        self.columns, self.degree, self.limit = list(columns), degree, limit

    def _fit(self, dataset: DataFrame) -> LibraryModel:
        terms = [t for t in features.polynomial(self.columns, self.degree) if t[0] != "1"]
        m = gram(dataset, [("1", F.lit(1.0)), *terms], [("0", F.lit(0.0))])
        mean = m.g[0, 1:] / m.n
        spread = m.g[1:, 1:] / m.n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-300))
        kept = features.correlation_prune(np.abs(spread / np.outer(scale, scale)), self.limit)
        return LibraryModel([terms[i][0] for i in kept], self)


class LibraryModel(Transformer):
    def __init__(self, names: list[str], how: Library):
        super().__init__()
        self.names, self.how = names, how

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms = dict(features.polynomial(self.how.columns, self.how.degree))
        return dataset.withColumns({n: terms[n] for n in self.names if n not in dataset.columns})


def best_predictor(dataset: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, intercept, slope, r2) of the one column that predicts the target best by a line; pairs with a null are left out."""
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.regr_intercept(target, c).alias("intercept"), F.regr_slope(target, c).alias("slope"), F.regr_r2(target, c).alias("r2"))
    rows = dataset.agg(F.array(*[pair(c) for c in columns]).alias("a")).select(F.explode("a").alias("r")).select("r.*").where("r2 IS NOT NULL")
    return rows.orderBy(F.desc("r2"), "column").limit(1)

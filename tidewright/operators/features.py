"""Candidate libraries as column expressions: nothing is materialised before the Gram aggregate."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import KEY, TIME, within_rows
from ..functions import expressions as ex

Term = tuple[str, Column]


def monomial_names(variables: list[str], degree: int) -> list[str]:
    """The names of polynomial()'s terms, in order."""
    return ["*".join(v for v, k in zip(variables, e, strict=True) for _ in range(k)) or "1" for e in exponents(len(variables), degree)]


def exponents(n: int, degree: int) -> list[tuple[int, ...]]:
    """Monomials of n variables by total degree from 0 to degree; within one, the last variable's powers come first."""
    out: list[tuple[int, ...]] = []

    def fill(head: tuple[int, ...], left: int) -> None:
        if len(head) == n - 1:
            out.append((*head, left))
            return
        for k in range(left + 1):
            fill((*head, k), left - k)

    for total in range(degree + 1):
        fill((), total) if n else out.append(())
    return out


def polynomial(variables: list[str], degree: int) -> list[Term]:
    terms = []
    for powers in exponents(len(variables), degree):
        column, names = F.lit(1.0), []
        for v, p in zip(variables, powers, strict=True):
            for _ in range(p):
                column = F.col(v) if not names else column * F.col(v)
                names.append(v)
        terms.append(("*".join(names) or "1", column))
    return terms


def trigonometric(variables: list[str]) -> list[Term]:
    return [t for v in variables for t in ((f"sin({v})", F.sin(v)), (f"cos({v})", F.cos(v)))]


def rational(variables: list[str]) -> list[Term]:
    return [(f"{v}/(1+{v}^2)", F.col(v) / (1 + F.col(v) * F.col(v))) for v in variables]


def interactions(variables: list[str]) -> list[Term]:
    if len(set(variables)) < len(variables):
        raise ValueError("a variable is given twice")
    return [(f"{a}*{b}", F.col(a) * F.col(b)) for a, b in combinations(variables, 2)]


def constrained(terms: list[Term], allowed: set[str] | None = None, most_nodes: int | None = None, needs_symbol: bool = False) -> list[Term]:
    """The terms, in order, whose expression (their name, parsed) has only allowed symbols, at most most_nodes nodes, and some symbol where one is needed."""
    kept = []
    for name, column in terms:
        e = ex.parse(name)
        if (allowed is None or ex.symbols(e) <= allowed) and (most_nodes is None or ex.size(e) <= most_nodes) and (not needs_symbol or ex.symbols(e)):
            kept.append((name, column))
    return kept


def design(df: DataFrame, terms: list[Term], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in terms])


def delay_embedding(df: DataFrame, column: str, delays: list[int]) -> DataFrame:
    """<column>_<d> for each delay in rows, without the rows that lack one."""
    add = lambda rows, w: rows.withColumns({f"{column}_{d}": F.lag("v_", d).over(w) for d in delays})
    out = within_rows(df.select(KEY, TIME, F.col(column).alias("v_")), max(delays, default=0), 0, add).drop("v_")
    return out.dropna(subset=[f"{column}_{d}" for d in delays])


def correlation_prune(correlations: np.ndarray, threshold: float) -> list[int]:
    """From left to right, the columns whose correlation with every kept one is at most threshold."""
    kept: list[int] = []
    for j in range(len(correlations)):
        if all(abs(correlations[j, k]) <= threshold for k in kept):
            kept.append(j)
    return kept

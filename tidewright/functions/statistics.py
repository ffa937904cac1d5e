"""Densities, quantiles and small statistics, as column expressions where they meet rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of Abramowitz and Stegun's formula 7.1.26 for erf, from the first power of t on, and its p.
ERF_P, ERF = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _scaled(value: Column, mean: float, deviation: float) -> Column:
    if not (math.isfinite(mean) and math.isfinite(deviation) and deviation > 0):
        raise ValueError("a normal distribution has a finite mean and a positive deviation")
    return (value - mean) / deviation


def normal_pdf(value: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    z = _scaled(value, mean, deviation)
    return F.exp(-z * z / 2) / (deviation * math.sqrt(2 * math.pi))


def normal_cdf(value: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """By the formula's erf, within 1.5e-7."""
    x = _scaled(value, mean, deviation) / math.sqrt(2)
    t, tail = 1 / (1 + ERF_P * F.abs(x)), F.lit(0.0)
    for c in reversed(ERF):
        tail = (tail + c) * t
    return 0.5 * (1 + F.signum(x) * (1 - tail * F.exp(-x * x)))


def z_for_confidence(confidence: float) -> float:
    """How many deviations to either side hold that share of a normal distribution."""
    if not 0 < confidence < 1:
        raise ValueError("a confidence lies between 0 and 1")
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)

"""Column expressions of the analytic operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy_bits(p: Column, eps: float = 1e-12) -> Column:
    """Binary entropy of a probability, in bits."""
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def binomial_limits(p0: Column, n: Column, k: float = 3.0) -> tuple[Column, Column]:
    """Lower (not under 0) and upper p-chart limits."""
    half = k * F.sqrt(p0 * (1 - p0) / n)
    return F.greatest(p0 - half, F.lit(0.0)), p0 + half


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 where it is undefined."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / root)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def small_sample(n1: Column, n0: Column) -> Column:
    """Hedges' correction factor."""
    return 1 - 3 / (4 * (n1 + n0) - 9.0)

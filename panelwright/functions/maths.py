"""Scalar expressions that Spark does not have."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def is_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as doubles have it, and as the SQL twins do: by zero it is infinite, of two zeros NaN, where Spark's division would stop the job. NaN is greater than any number in both engines."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
    return F.when(b == 0, by_zero).otherwise(a / b)


def half_up(x: Column, digits: int) -> Column:
    """A double rounded to ``digits`` places, halves away from zero, by whole numbers where these are exact: ``round`` takes each value through a decimal, at many times the cost. It still does the rest, infinite and NaN."""
    power, below_half = 10.0**digits, math.nextafter(0.5, 0.0)  # so that what is just below a half stays below
    up = lambda v: F.floor(v * power + below_half)
    return F.when(F.abs(x) < 1e14 / power, F.when(x < 0, -up(-x)).otherwise(up(x)) / power).otherwise(F.round(x, digits))


def sharpe_ratio(x: str, bars_per_year: float) -> Column:
    """Aggregate: mean over deviation, annual. NaN of a series that is 0 throughout, such as that of a strategy that never trades."""
    return ratio(F.avg(x), F.stddev_samp(x)) * bars_per_year**0.5


def wilson(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of a share ``p`` seen in ``n`` (possibly fractional) trials, clipped to [0, 1]; null without trials."""
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, clip(mid - half, 0.0, 1.0)), F.when(n > 0, clip(mid + half, 0.0, 1.0))


def adjusted_skew(skew: Column, n: Column) -> Column:
    """Sample-adjusted from Spark's population skewness."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(kurt: Column, n: Column) -> Column:
    """Sample-adjusted excess kurtosis from Spark's population one."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6))


def normal_cdf(x: Column) -> Column:
    """By the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8)."""
    # Fixed values of that formula.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


#: Fixed values of Acklam's rational approximation of the normal quantile: central numerator and denominator, tail numerator and denominator.
ACKLAM = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def horner(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Three branches, joined at 0.02425 from either end; null outside (0, 1)."""
    a, b, c, d = ACKLAM
    mid, low = p - 0.5, 0.02425
    tail = lambda q: horner(c, F.sqrt(-2 * F.ln(q))) / horner(d, F.sqrt(-2 * F.ln(q)))
    centre = horner(a, mid * mid) * mid / horner(b, mid * mid)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(centre)

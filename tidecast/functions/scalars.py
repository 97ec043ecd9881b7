"""Column helpers shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def day_of_week(d: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(d).cast("bigint")


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


def week_of_year(d: Column) -> Column:
    """Sunday-start week; days before the first Sunday of the year are week 0."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """Double division that gives NULL on a zero or NULL divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_ratio(a: Column, b: Column) -> Column:
    """``ratio`` with rounding noise treated as a zero divisor."""
    return F.when(b > 1e-12, a / b)


def verdict(passed: Column, otherwise: str = "FAIL") -> Column:
    return F.when(passed, F.lit("PASS")).otherwise(F.lit(otherwise))


def z_score(level: float) -> float:
    """Half-width, in standard deviations, of a two-sided normal interval."""
    return NormalDist().inv_cdf((1.0 + level) / 2.0)


def two_sided_probability(z: Column) -> Column:
    """P(|N(0,1)| < |z|) by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = F.lit(1.061405429)
    for coefficient in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = series * t + coefficient
    return 1.0 - series * t * F.exp(-x * x)


def over_rows(keys, order, start: int, end: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(start, end)

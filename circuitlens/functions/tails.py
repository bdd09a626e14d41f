"""Tail probabilities as Column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, functions as F

#: Terms of the series below 2 and of the continued fraction from 2 on: enough for 14 digits.
SERIES, FRACTION = 60, 80


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, by a series of positive terms, from 2 on by a continued fraction."""
    x = x.cast("double")
    square = x * x
    start = F.struct(x.alias("term"), x.alias("total"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES)), start, lambda s, k: F.struct((s["term"] * 2 * square / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * 2 * square / (2 * k + 1)).alias("total"))
    )["total"]
    low = 1 - 2 / sqrt(pi) * F.exp(-square) * grown
    folded = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), x, lambda s, k: x + k / 2 / s)
    high = F.exp(-square) / (sqrt(pi) * folded)
    return F.when(x < 2, F.greatest(low, F.lit(0.0))).otherwise(high)


def normal_sf(z: Column) -> Column:
    """P(Z >= z) of a standard normal."""
    half = erfc(F.abs(z) / sqrt(2)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi2_sf(x: Column) -> Column:
    """P(X >= x) of a chi-squared distribution with one degree of freedom."""
    return erfc(F.sqrt(x / 2))

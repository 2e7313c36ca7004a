"""Closed-form statistics over aggregated columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles of a two-sided 95% interval.
MEAN_CI_Z = 1.96
CHI2_Z = 1.959964


def guarded(condition: Column, value: Column) -> Column:
    """The value where the condition holds, otherwise NULL."""
    return F.when(condition, value)


def null_rate(null_count: Column, total_count: Column) -> Column:
    return guarded(total_count > 0, F.round(null_count / total_count, 6))


def mean_margin(stddev: Column, n: Column) -> Column:
    """Half-width of the 95% interval of a mean."""
    return guarded((n > 1) & stddev.isNotNull(), MEAN_CI_Z * stddev / F.sqrt(n))


def stddev_bound(stddev: Column, n: Column, chi2: Column) -> Column:
    """One end of the chi-squared interval of a standard deviation."""
    return guarded((n > 1) & stddev.isNotNull(), stddev * F.sqrt((n - 1) / chi2))


def skewness_from_sums(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Population skewness from sums of powers about any fixed point."""
    mu, e2, e3 = s1 / n, s2 / n, s3 / n
    m2 = e2 - mu * mu
    m3 = e3 - 3 * mu * e2 + 2 * F.pow(mu, F.lit(3))
    return guarded((n >= 3) & (m2 > 0), m3 / F.pow(m2, F.lit(1.5)))


def kurtosis_from_sums(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Population excess kurtosis from sums of powers about any fixed point."""
    mu, e2, e3, e4 = s1 / n, s2 / n, s3 / n, s4 / n
    m2 = e2 - mu * mu
    m4 = e4 - 4 * mu * e3 + 6 * mu * mu * e2 - 3 * F.pow(mu, F.lit(4))
    return guarded((n >= 4) & (m2 > 0), m4 / (m2 * m2) - 3)


def chi2_quantile(df: Column, z: float) -> Column:
    """Wilson-Hilferty approximation of a chi-squared quantile, for df above the exact table."""
    spread = 2.0 / (9.0 * df)
    return df * F.pow(1.0 - spread + z * F.sqrt(spread), F.lit(3))

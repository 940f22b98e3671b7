"""Rates and confidence intervals as columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float) -> float:
    """The normal quantile of a two-sided interval."""
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def bernoulli_ci(p: Column, n: Column, confidence: float = 0.95, method: str = "wald") -> tuple[Column, Column]:
    """Lower and upper bounds for a rate p of n. wald: p -+ z sqrt(p (1 - p) / n), unclipped; wilson: score interval.
    Null for no rows."""
    z = F.lit(z_value(confidence))
    spread = F.greatest(p * (1 - p), F.lit(0.0))
    if method == "wald":
        half = z * F.sqrt(spread / n)
        return p - half, p + half
    if method == "wilson":
        middle, scale = (p + z * z / (2 * n)), 1 + z * z / n
        half = z * F.sqrt(spread / n + z * z / (4 * n * n))
        return (middle - half) / scale, (middle + half) / scale
    raise ValueError(f"unknown method {method!r}")


def sample_std(c: Column) -> Column:
    """The sample standard deviation; 0 for one row."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def pass_rate(kept: Column) -> Column:
    """Per cent of rows kept; 0 for no rows."""
    return F.lit(100.0) * F.count_if(kept) / F.greatest(F.count(F.lit(1)), F.lit(1))


def verdict(delta: Column, margin: float = 0.05) -> Column:
    """validated above the margin, inconclusive above 0, else failed; a missing delta fails."""
    known = ~F.isnan(delta)
    return F.when(known & (delta > margin), "validated").when(known & (delta > 0), "inconclusive").otherwise("failed")

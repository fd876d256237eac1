"""Scalar number rules shared by the operators (all NULL-aware, JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_divide(a, b) -> Column:
    """a / b, NULL when either side is NULL or b is zero."""
    return F.try_divide(col(a), col(b))


def safe_corr(x: str, y: str) -> Column:
    """Sample correlation over rows with both values; NULL when a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_samp(F.when(both, F.col(c)))
    return F.try_divide(F.covar_samp(x, y), sd(x) * sd(y))


def growth_rate(current, previous) -> Column:
    """(current - previous) / |previous|, NULL when undefined."""
    return F.try_divide(col(current) - col(previous), F.abs(col(previous)))


def normalize_range(c, low: float, high: float, invert: bool = False) -> Column:
    """Scale to 0..100 with clamping; NULL is neutral 50."""
    scaled = clamp((col(c) - low) / (high - low) * 100, 0, 100)
    # greatest and least skip NULLs, so a clamped NULL would be the upper bound
    return F.when(col(c).isNull(), 50.0).otherwise(100 - scaled if invert else scaled)


def bounded_score(c) -> Column:
    """Clamp to 0..100; not-finite values become 50."""
    return clamp(F.coalesce(finite(c), F.lit(50.0)), 0, 100)


def mean_present(parts: list[Column], default: float | None = None) -> Column:
    """Mean of the non-NULL parts, summed in list order; ``default`` when none is present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    mean = F.when(n > 0, total / n)
    return mean if default is None else F.coalesce(mean, F.lit(default))


def first_non_empty(*parts) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(col(p), F.lit("")) for p in parts])

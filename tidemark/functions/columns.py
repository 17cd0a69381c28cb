"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# The normal distribution's polynomial approximation (Abramowitz and Stegun 26.2.17), as the results need it.
CDF_SCALE = 0.2316419
CDF_DENSITY = 0.3989423
CDF_TERMS = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)

INF = float("inf")


def by_time(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("time")


def last_rows(n: int, *keys: str) -> WindowSpec:
    """The frame of the last n rows, the current one included."""
    return by_time(*keys).rowsBetween(-(n - 1), 0)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + CDF_SCALE * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(CDF_TERMS):
        poly = t * (F.lit(c) + poly)
    p = CDF_DENSITY * F.exp(-z * z / 2) * poly
    return F.when(z > 0, 1 - p).otherwise(p)


def p_value(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def over(x: Column, y: Column, default: float | None = 0.0) -> Column:
    """x / y, or the default where y is zero or either is null."""
    ratio = F.try_divide(x, y)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def std0(x: Column) -> Column:
    """Sample deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def or_tiny(x: Column, tiny: float = 1e-9) -> Column:
    """x, or a tiny number where it is zero or null."""
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, F.lit(tiny)).otherwise(x)


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + 0.5)


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0 to bins - 1; the maximum falls in the last one."""
    span = or_tiny(high - low)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - low) / span * bins))).cast("int")


def ewma(values: Column, alpha: float) -> Column:
    """Exponentially weighted mean of an array, its first element as seed, the last weighs most; 0 for an empty one."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.aggregate(rest, F.element_at(values, 1).cast("double"), lambda a, x: F.lit(alpha) * x + F.lit(1 - alpha) * a))


def share_at_most(values: Column, x: Column) -> Column:
    """Percentile rank: the share of an array's values that are at most x."""
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.size(F.filter(values, lambda v: v <= x)) / F.size(values))


def fixed(x: Column, digits: int = 2) -> Column:
    """Text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def regime_of_hurst(h: Column) -> Column:
    return F.when(h > 0.55, "persistent").when(h < 0.45, "anti-persistent").otherwise("random-walk")

"""Aggregate expressions over groups; defaults for short or degenerate input are part of their meaning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import INF, p_value, std0


def mean0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance0(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def slope0(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x, 0 where it isn't defined."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def sharpe(r: Column, per_year: float = 252.0) -> Column:
    s = std0(r)
    return F.when((F.count(r) >= 2) & (s > 0), F.avg(r) / F.nullif(s, F.lit(0.0)) * math.sqrt(per_year)).otherwise(F.lit(0.0))


def sortino(r: Column, per_year: float = 252.0) -> Column:
    """Infinite where the mean is positive and nothing was lost."""
    losses = F.count(F.when(r < 0, r))
    down = F.sqrt(F.avg(F.when(r < 0, r * r)))
    return F.when(F.count(r) < 2, F.lit(0.0)).when(losses == 0, F.when(F.avg(r) > 0, F.lit(INF)).otherwise(F.lit(0.0))).otherwise(F.coalesce(F.try_divide(F.avg(r), down), F.lit(0.0)) * math.sqrt(per_year))


def t_stat(r: Column) -> Column:
    s = std0(r)
    return F.when((F.count(r) >= 2) & (s > 0), F.avg(r) * F.sqrt(F.count(r)) / F.nullif(s, F.lit(0.0))).otherwise(F.lit(0.0))


def t_p_value(r: Column) -> Column:
    s = std0(r)
    return F.when((F.count(r) >= 2) & (s > 0), p_value(t_stat(r))).otherwise(F.lit(1.0))


def life_of_slope(slope: Column, n: Column) -> Column:
    """Half-life of a mean reversion with dx = slope * (x - mean); infinite where there is none or fewer than 10 values."""
    phi = -slope
    return F.when((n >= 10) & (phi > 0) & (phi < 1), -math.log(2) / F.log(1 - F.when((phi > 0) & (phi < 1), phi))).otherwise(F.lit(INF))


def half_life(x: Column, before: Column) -> Column:
    """Half-life of x against its own previous value (null for the first): n counts x."""
    return life_of_slope(slope0(x - before, before), F.count(x))


def log_fit(y: Column, x: Column) -> tuple[Column, Column]:
    """Slope and r2 of ln y on ln x, 0 where not defined."""
    return F.coalesce(F.regr_slope(F.ln(y), F.ln(x)), F.lit(0.0)), F.coalesce(F.regr_r2(F.ln(y), F.ln(x)), F.lit(0.0))


def profit_factor(pnl: Column) -> Column:
    """Infinite without losses; a pnl of zero is a loss."""
    won, lost = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)))
    return F.when(lost == 0, F.when(won > 0, F.lit(INF)).otherwise(F.lit(0.0))).otherwise(F.try_divide(won, lost))

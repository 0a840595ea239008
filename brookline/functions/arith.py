"""The expression language's arithmetic on Columns; every value is a finite double in this layer.

Division by zero gives zero; MOD is floored; ROUND goes away from zero at halves; a NaN never passes a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def fin(x: Column | str | float) -> Column:
    """x where it is a finite number, else 0."""
    x = col(x)
    return F.when(is_finite(x), x).otherwise(0.0)


def safe_div(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(b != 0, F.try_divide(a, b)).otherwise(0.0)


def clamp(v, lo, hi) -> Column:
    """max(lo, min(hi, v)): lo wins where lo > hi."""
    return F.greatest(col(lo), F.least(col(hi), col(v)))


def floored_mod(a, b) -> Column:
    """Remainder with the divisor's sign; 0 for a zero divisor, NaN where an operand is not finite."""
    a, b = col(a), col(b)
    left = a - b * F.floor(F.try_divide(a, b)).cast("double")
    return F.when(~(is_finite(a) & is_finite(b)), F.lit(float("nan"))).when(b == 0, 0.0).otherwise(left)


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


def round_away(x) -> Column:
    return F.round(col(x)).cast("double")


def step(x, threshold) -> Column:
    x, threshold = col(x), col(threshold)
    return F.when(~F.isnan(x) & (x >= threshold), 1.0).otherwise(0.0)


def fires(bin_: Column, period: int, phase: int = 0) -> Column:
    """Bins at which a schedule of this period is open, from its phase on."""
    if period <= 0 or phase < 0:
        raise ValueError("a period is positive and a phase not negative")
    return (bin_ >= phase) & ((bin_ - phase) % period == 0)


def pulse(bin_: Column, period: int, phase: int = 0, amplitude=1.0) -> Column:
    return F.when(fires(bin_, period, phase), col(amplitude)).otherwise(0.0)


def shown(x: Column) -> Column:
    """As results show a derived metric: null if not finite, 0 if tiny, else six decimals."""
    return F.when(is_finite(x), F.when(F.abs(x) < 1e-9, 0.0).otherwise(F.round(x, 6)))

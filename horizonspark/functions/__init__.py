"""Column functions shared by the operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(x: Column, low: float) -> Column:
    """max(x, low), but null stays null (greatest() alone would return low)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def not_nan(x: Column) -> Column:
    """NaN as null, for values that come from files or Python."""
    return F.when(~F.isnan(x), x)


def flag(condition: Column) -> Column:
    """1 or 0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x.cast("double"), digits)


def round_exact(x: Column, digits: int = 4) -> Column:
    """x rounded as Python's round does: by the exact value of the double, halves to even; for magnitudes up to 10^10 and at most 4 digits.

    Products with a scale are not exact, so x is compared with the half between its two neighbours in two parts whose products are.
    """
    scale = 10**digits
    n = F.floor(x * scale)
    up = x * float((1 << 27) + 1)
    high = up - (up - x)
    above = (high * (2.0 * scale) - (2.0 * n + 1)) + (x - high) * (2.0 * scale)
    nearest = F.when(above > 0, n + 1).when(above < 0, n).otherwise(n + F.pmod(n, F.lit(2)))
    return nearest.cast("double") / scale


def base_date(target: str = "target_date", horizon: str = "horizon") -> Column:
    """The newest day that a forecast of `target` made `horizon` days ahead may read."""
    return F.date_sub(F.col(target), F.col(horizon) + 1)

"""Exact money and ratios.

Costs are whole numbers of 1e-8 USD (a rate of one cent per million tokens costs one unit a token), so sums are exact in
any order; one BIGINT holds 92 billion USD. They become dollars only at the edge. Every rounding is half up, of one
division of exact numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_USD = 100_000_000


def _half_up(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x + F.lit(0.5)).cast("double") / F.lit(scale)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def usd(units: Column | str, digits: int = 4) -> Column:
    """Units as dollars, rounded to ``digits``."""
    return _half_up(_col(units).cast("double") / F.lit(float(10 ** (8 - digits))), digits)


def ratio(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    """a / b rounded; null where b is 0 or null."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.when(b != 0, _half_up(a * F.lit(float(10**digits)) / b, digits))


def share(a: Column | str, b: Column | str) -> Column:
    """a as a percentage of b to one decimal; 0 where b is 0."""
    return F.coalesce(ratio(_col(a) * 100, b, 1), F.lit(0.0))


def filled(x: Column | str, default: str) -> Column:
    """``x``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(_col(x), F.lit("")), F.lit(default))

"""Null-safe casts and ratios (ANSI mode never throws on bad input here)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_zero(c, to: str = "double") -> Column:
    """Cast text to a number, 0 when it does not parse (the ``…OrZero`` family)."""
    return F.coalesce(_c(c).try_cast(to), F.lit(0).cast(to))


def ratio(num, den) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    """Percentage num*100/den (NULL on zero denominator)."""
    return ratio(_c(num).cast("double") * F.lit(100.0), den)


def round_d(c, places: int = 6) -> Column:
    return F.round(_c(c).cast("double"), places)

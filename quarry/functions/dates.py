"""Calendar bucketing with the workload's semantics (weeks start Monday,
ISO weekday numbers, unit-boundary date differences)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def start_of_day(c) -> Column:
    return F.to_date(_c(c))


def start_of_week(c) -> Column:
    """Monday of the week, as a DATE."""
    return F.to_date(F.date_trunc("week", _c(c)))


def start_of_month(c) -> Column:
    return F.trunc(F.to_date(_c(c)), "MM")


def iso_weekday(c) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(_c(c)) + 1


def in_years(c, first: int, last: int) -> Column:
    """Timestamp within the calendar years, as a range that parquet scans can prune on."""
    return (_c(c) >= F.lit(f"{first}-01-01").cast("timestamp_ntz")) & (_c(c) < F.lit(f"{last + 1}-01-01").cast("timestamp_ntz"))


_TRUNC = {"second": "second", "minute": "minute", "hour": "hour", "day": "day", "month": "month",
          "year": "year"}


def boundary_diff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed from ``start`` to ``end``.

    This is the date-diff convention of the workload (it counts calendar
    boundaries, not elapsed full units): truncate both ends, then count
    whole units between the truncated values.
    """
    unit = unit.lower()
    s, e = _c(start), _c(end)
    if unit == "day":
        return F.datediff(F.to_date(e), F.to_date(s))
    if unit not in _TRUNC:
        raise ValueError(f"unsupported unit {unit}")
    # date_trunc returns a zoned timestamp; back to wall-clock (ntz) values so
    # the count does not depend on the session time zone's DST rules
    return F.timestamp_diff(unit.upper(), F.date_trunc(_TRUNC[unit], s).cast("timestamp_ntz"),
                            F.date_trunc(_TRUNC[unit], e).cast("timestamp_ntz"))

"""Column-expression helpers (built-in Spark functions only; JVM-side, codegen'd)."""

from quarry.functions.dates import (boundary_diff, in_years, iso_weekday, start_of_day, start_of_month, start_of_week)
from quarry.functions.scalars import or_zero, pct, ratio, round_d

__all__ = ["boundary_diff", "in_years", "iso_weekday", "start_of_day", "start_of_month", "start_of_week", "or_zero", "pct", "ratio", "round_d"]

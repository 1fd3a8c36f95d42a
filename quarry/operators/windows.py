"""Window recipes: moving frames, growth, spikes, normalisation, top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(partition_by: Sequence[str], order: Sequence[Column | str], lo, hi):
    return Window.partitionBy(*partition_by).orderBy(*order).rowsBetween(lo, hi)


def running(partition_by, order):
    return frame(partition_by, order, Window.unboundedPreceding, Window.currentRow)


def top_n_per_group(df: DataFrame, partition_by: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str = "rn") -> DataFrame:
    """row_number <= n per group.  Spark inserts a WindowGroupLimit below the
    shuffle, so every map task forwards at most n rows per group: a hot
    group costs n rows of shuffle, not a third of the table."""
    w = Window.partitionBy(*partition_by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def growth_pct(cur: Column, prev: Column, places: int = 2) -> Column:
    """(cur - prev) * 100 / prev, NULL when prev is NULL or 0."""
    return F.round(F.try_divide((cur - prev).cast("double") * 100.0, prev.cast("double")), places)


def min_max_normalise(value: str, w) -> Column:
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(value) - lo).cast("double") / (hi - lo).cast("double"))

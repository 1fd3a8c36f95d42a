"""Generic relational helpers used across plans (F, O, U ops)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arr_str(c, sep: str = ",") -> Column:
    """Sorted array rendered as text — a stable, engine-neutral form for output."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(c), sep)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """ORDER BY … LIMIT k; Catalyst plans TakeOrderedAndProject (per-partition
    top-k, then a k-row merge), so no full sort is shuffled."""
    return df.orderBy(*order).limit(k)


def ts_lit(s: str) -> Column:
    """A timestamp_ntz literal (constant-folded, so it still pushes down)."""
    return F.lit(s).cast("timestamp_ntz")


def max_ts(df: DataFrame, col: str, name: str = "as_of") -> DataFrame:
    """One-row frame holding max(col): the data's own 'now' anchor."""
    return df.agg(F.max(col).alias(name))


def multiset_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` not covered by ``right`` with multiplicity (EXCEPT ALL)."""
    return left.exceptAll(right)


def row_key(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Canonical per-row key: sha-256 of the JSON of the row's cells."""
    cols = cols or df.columns
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols])), 256)


def multiset_diff_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row-key counts of both sides, full-joined; returns keys whose counts differ.

    Map-side partial counts make this a single shuffle of (key, count) pairs,
    however large and however skewed the row multiset is.
    """
    ca = a.select(row_key(a).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("na"))
    cb = b.select(row_key(b).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("nb"))
    j = ca.join(cb, "k", "full_outer").fillna(0, ["na", "nb"])
    return j.where(F.col("na") != F.col("nb"))

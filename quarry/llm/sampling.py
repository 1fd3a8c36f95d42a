"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 30


def bounded_sample(rows: DataFrame, key: Column, quota: int, by: str | None = None, seed: int = 7) -> DataFrame:
    """About ``quota`` rows (of each value of ``by``), chosen by a hash of ``key``.

    The fraction comes from a count over all rows, so the sample's size does
    not grow with the table; rows that share a key are taken once.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << _BITS))
    group = F.col(by) if by else F.lit("")
    counts = {r["g"]: r["n"] for r in rows.groupBy(group.cast("string").alias("g")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for g, n in sorted(counts.items()) for x in (g, max(1, int((1 << _BITS) * min(1.0, quota / n))))])
    return (rows.withColumn("_key", key).where(h < limit[group.cast("string")]).dropDuplicates(["_key"]).drop("_key"))

"""Distinct counts that merge: flags per key, bitmaps over codes, sketches.

Several distinct counts in one aggregate make Spark copy every row once per
count.  Here a row is never copied: conditional counts of one key come from
one (group, key) row with flags, counts of many columns from one unpivoted
distinct, and counts that are to be rolled up later (days to weeks and
months) from stored bitmaps, exact, or stored sketches, approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path


def distinct_if(df: DataFrame, group: Sequence[str], key: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group and name, the number of distinct non-null ``key`` values of the rows that meet the condition."""
    flags = df.groupBy(*group, key).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    return flags.groupBy(*group).agg(*[F.count_if(F.col(n) & F.col(key).isNotNull()).alias(n) for n in conditions])


def column_values(df: DataFrame) -> DataFrame:
    """(column_name, v): the distinct non-null values of every column as text, by one unpivoted distinct."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        # a negative zero is zero
        return (F.col(c) + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(c)).cast("string")

    return (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("v")) for c in df.columns])))
            .where(F.col("v").isNotNull()).distinct())


def dictionary(df: DataFrame, key: str) -> DataFrame:
    """(key, code): a small non-negative number for every distinct non-null ``key``, written once."""
    path = scratch_path(df.sparkSession, "dictionary")
    df.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    raw = df.sparkSession.read.parquet(path)
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    width = int(raw.agg(F.max(place)).first()[0] or 0).bit_length()
    return raw.select(key, (F.shiftleft(F.shiftright("_at", 33), width) + place).alias("code"))


def write_distinct_bitmaps(df: DataFrame, group: Sequence[str], key: str, path: str) -> None:
    """Write (group..., bucket, bits): per group the set of ``key`` values as
    bitmaps over dictionary codes, 32,768 codes a bucket, so that a group with
    any number of keys is spread over buckets and merges by OR."""
    coded = df.select(*group, key).distinct().join(dictionary(df, key), key)
    (coded.groupBy(*group, F.bitmap_bucket_number("code").alias("bucket"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits")).write.parquet(path))


def count_bitmaps(bitmaps: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Distinct counts per ``group`` (any roll-up of the stored groups) from stored bitmaps."""
    merged = bitmaps.groupBy(*group, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*group).agg(F.sum(F.bitmap_count("bits")).alias(name))


#: log2 of the registers of a sketch, and the relative standard error that goes with them
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_LG_K) ** 0.5


def write_distinct_sketches(df: DataFrame, group: Sequence[str], key: str, path: str) -> None:
    """Write (group..., sketch): a HyperLogLog sketch of the ``key`` values per group; a few kilobytes whatever their number."""
    df.groupBy(*group).agg(F.hll_sketch_agg(key, F.lit(SKETCH_LG_K)).alias("sketch")).write.parquet(path)


def estimate_sketches(sketches: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Estimated distinct counts per ``group`` (any roll-up of the stored groups) from stored sketches."""
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))

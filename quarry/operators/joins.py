"""Join helpers: size-checked broadcast, star joins, membership joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

# A side is broadcast only when the optimizer's size estimate is below this
# bound; otherwise the join is left to sort-merge (and AQE may still switch
# it to broadcast with exact runtime sizes).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (None when unavailable)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # pragma: no cover - plan stats unavailable
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is proven under ``limit``."""
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, task_bytes: int = 32 * 1024 * 1024) -> DataFrame:
    """``df`` dealt over all cores before costly work on its rows, if it is too small to fill them by its files
    (a file of one row group is one task); larger inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    return df.repartition(cores) if size is not None and size < cores * task_bytes else df


def semi_join_top_k(df: DataFrame, key: str, k: int, weight: str | None = None) -> DataFrame:
    """Keep rows whose ``key`` is among the top-k keys by row count.

    The top-k list has k rows by construction, so it is broadcast.
    """
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    top = (df.groupBy(key).agg(agg.alias("_w"))
           .orderBy(F.col("_w").desc(), F.col(key)).limit(k).select(key))
    return df.join(F.broadcast(top), key, "left_semi")


def heavy_keys(df: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Key values (nulls included) that hold more than a ``2 * tasks``-th of the rows: at most ``2 * tasks`` of them, written."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    path = scratch_path(df.sparkSession, "heavy-keys")
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    counts.crossJoin(F.broadcast(total)).where(F.col("_n") * 2 * tasks > F.col("_all")).select(*keys).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join (inner, left, left_semi or left_anti) in which keys that hold
    a large share of ``left`` are dealt over as many tasks as there are.

    The heavy keys are found by one map-side combined count; their rows on the
    left get a salt, their rows on the right one copy a salt.  Other keys
    join as usual.  Unlike a skewed join found at run time, the split stays
    when a later step groups by the same keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    heavy = heavy_keys(left, keys, tasks)
    hot = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot")))

    def marked(df: DataFrame) -> DataFrame:
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
        return df.join(hot, same, "left").drop(*[f"_h_{k}" for k in keys])

    # the salt is a function of the row and its scan task, so a task that runs again gives the same
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.lit(tasks)).cast("int")
    a = marked(left.withColumn("_salt", salt)).withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0)).drop("_hot")
    b = (marked(right.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumns({k: F.col(f"_r_{k}") for k in keys})).drop(*keys)
         .withColumn("_r_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0))))).drop("_hot"))
    on = F.col("_salt") == F.col("_r_salt")
    for k in keys:
        on = on & (F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}"))
    return a.join(b, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def anti_join_not_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """``key NOT IN (SELECT other_key … WHERE other_key IS NOT NULL)``."""
    ok = other_key or key
    rhs = other.where(F.col(ok).isNotNull()).select(F.col(ok).alias("_k")).distinct()
    return df.join(rhs, df[key] == rhs["_k"], "left_anti")

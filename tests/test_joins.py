"""Joins on hot keys."""

import pytest
from pyspark.sql import functions as F

from quarry.operators.joins import heavy_keys, skew_join


def _sides(spark):
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 29 == 0, None).otherwise(F.col("id") % 500)
    left = spark.range(6000).select("id", k.alias("k"), F.lit("x").alias("v"))
    right = spark.range(400).select(F.when(F.col("id") == 399, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("w")).unionByName(
        spark.createDataFrame([(7, -1), (7, -1), (None, -2)], "k long, w long"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_skew_join_equals_join(spark, how, null_safe):
    left, right = _sides(spark)
    r = right.withColumnRenamed("k", "rk")
    on = F.col("k").eqNullSafe(F.col("rk")) if null_safe else F.col("k") == F.col("rk")
    want = left.join(r, on, how)
    want = want.drop("rk") if "rk" in want.columns else want
    got = skew_join(left, right, ["k"], how, null_safe)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_is_dealt_over_tasks(spark):
    left, right = _sides(spark)
    assert [r["k"] for r in heavy_keys(left, ["k"], 8).collect()] == [7]
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = sorted(r["count"] for r in skew_join(left, right.dropDuplicates(["k"]), ["k"]).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_months_are_pruned_at_run_time(spark):
    from quarry.plans.workload_joins import pruned_star
    from quarry.sources.tables import Tables
    df = pruned_star(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert df.count() > 0


def test_runtime_filter_on_a_shuffled_dimension(spark):
    """With large enough inputs Spark filters the fact by a Bloom filter of the dimension's keys; here the bound is lowered."""
    sf = "/root/testdata/sf0.001"
    low = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in low}
    for c, v in low.items():
        spark.conf.set(c, v)
    try:
        li, part = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet")
        j = li.join(part.where("p_brand = 'Brand#1'"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("l_quantity"))
        assert "might_contain" in j._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)

"""Mergeable distinct counts."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.operators.distincts import (SKETCH_ERROR, column_values, count_bitmaps, distinct_if, estimate_sketches,
                                        write_distinct_bitmaps, write_distinct_sketches)
from quarry.session import scratch_path


@pytest.mark.parametrize("key", ["A8_conditional_distinct", "R13_funnel_by_country", "P1_table_profile", "R4_cohort_retention", "J13_month_offset_join", "A8_distinct_rollup"])
def test_no_row_is_copied_per_count(spark, key):
    assert "Expand" not in E.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def _rows(n=3000):
    r = random.Random(4)
    return [(r.choice([1, 2, 3, None]), None if r.random() < 0.1 else f"k{r.randint(0, 400)}", r.choice("ab")) for _ in range(n)]


def test_counts_equal_sets(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "day int, k string, kind string")
    want = {d: len({k for x, k, _ in rows if x == d and k is not None}) for d in (1, 2, 3, None)}
    bitmaps, sketches = scratch_path(spark, "test-bitmaps"), scratch_path(spark, "test-sketches")
    write_distinct_bitmaps(df.where("k is not null"), ["day"], "k", bitmaps)
    write_distinct_sketches(df.where("k is not null"), ["day"], "k", sketches)
    stored = spark.read.parquet(bitmaps)
    assert {r["day"]: r["n"] for r in count_bitmaps(stored, ["day"], "n").collect()} == want
    both = stored.withColumn("all", F.lit(1))
    assert count_bitmaps(both, ["all"], "n").first()["n"] == len({k for _, k, _ in rows if k is not None})
    for r in estimate_sketches(spark.read.parquet(sketches), ["day"], "n").collect():
        assert abs(r["n"] - want[r["day"]]) <= 3 * SKETCH_ERROR * want[r["day"]] + 0.5
    got = {r["day"]: (r["a"], r["b"]) for r in distinct_if(df, ["day"], "k", {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}).collect()}
    assert got == {d: tuple(len({k for x, k, y in rows if x == d and y == z and k is not None}) for z in "ab") for d in (1, 2, 3, None)}


def test_column_values(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (1, -0.0, None), (2, 1.5, "x")], "a int, b double, c string")
    got = {}
    for r in column_values(df).collect():
        got.setdefault(r["column_name"], set()).add(r["v"])
    assert got == {"a": {"1", "2"}, "b": {"0.0", "1.5"}, "c": {"x"}}

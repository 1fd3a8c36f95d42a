"""Skew-safe ranking / ntile / quantiles agree with Spark windows and numpy."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.ranking import exact_quantiles, ranked


def _data(spark):
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{i % 7}"          # one group holds two thirds of the rows
        rows.append((i, g, float((i * 37) % 101)))
    return spark.createDataFrame(rows, "id int, g string, v double")


def test_ranked_matches_window(spark):
    df = _data(spark)
    ours = ranked(df, [F.col("v").desc()], ["g"], rank="r", dense_rank="dr")
    ours = ranked(ours, [F.col("v"), F.col("id")], ["g"], row_number="rn", ntile=("nt", 4))
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    w2 = Window.partitionBy("g").orderBy("v", "id")
    ref = df.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"),
                    F.row_number().over(w2).alias("rn"), F.ntile(4).over(w2).alias("nt"))
    a = sorted(tuple(r) for r in ours.select("id", "r", "dr", "rn", "nt").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_global_ntile(spark):
    df = _data(spark)
    ours = ranked(df, [F.col("v"), F.col("id")], ntile=("q", 7)).select("id", "q")
    ref = df.select("id", F.ntile(7).over(Window.orderBy("v", "id")).alias("q"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_exact_quantiles(spark):
    df = _data(spark)
    q = {r["g"]: r for r in exact_quantiles(df, "v", [0.25, 0.5, 0.95], ["g"]).collect()}
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        for p, name in [(0.25, "p25"), (0.5, "p50"), (0.95, "p95")]:
            assert abs(q[g][name] - np.quantile(sub["v"].to_numpy(), p)) < 1e-9
    glob = exact_quantiles(df, "v", [0.5]).first()["p50"]
    assert abs(glob - np.quantile(pdf["v"].to_numpy(), 0.5)) < 1e-9


def test_running_and_shift(spark):
    from quarry.operators.ranking import shifted
    df = _data(spark)
    ours = ranked(df, [F.col("v"), F.col("id")], ["g"],
                  running=[("sum", "v", "rs"), ("count", "v", "rc"), ("max", "v", "rmax"), ("min", "v", "rmin")])
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("rs"), F.count("v").over(w).alias("rc"),
                    F.max("v").over(w).alias("rmax"), F.min("v").over(w).alias("rmin"))
    a = {r["id"]: (round(r["rs"], 6), r["rc"], r["rmax"], r["rmin"]) for r in ours.collect()}
    b = {r["id"]: (round(r["rs"], 6), r["rc"], r["rmax"], r["rmin"]) for r in ref.collect()}
    assert a == b
    both = shifted(df, [F.col("v"), F.col("id")], ["g"], [(["id"], 1, "prev_"), (["id"], -1, "next_")])
    lag = lead = both
    w2 = Window.partitionBy("g").orderBy("v", "id")
    refl = {r["id"]: (r["p"], r["n"]) for r in df.select("id", F.lag("id").over(w2).alias("p"),
                                                         F.lead("id").over(w2).alias("n")).collect()}
    gotl = {r["id"]: r["prev_id"] for r in lag.collect()}
    gotn = {r["id"]: r["next_id"] for r in lead.collect()}
    assert all(gotl[i] == refl[i][0] and gotn[i] == refl[i][1] for i in refl)


def test_moving_frame(spark):
    from quarry.operators.ranking import moving_frame
    df = _data(spark)
    for lo, hi in [(-6, 0), (-5, -1)]:
        ours = moving_frame(df, [F.col("v"), F.col("id")], ["g"], "v", lo, hi, ["id"], "ma")
        w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(lo, hi)
        ref = df.select("id", F.avg("v").over(w).alias("ma"))
        a = {r["id"]: None if r["ma"] is None else round(r["ma"], 9) for r in ours.collect()}
        b = {r["id"]: None if r["ma"] is None else round(r["ma"], 9) for r in ref.collect()}
        assert a == b


def test_null_groups_are_groups(spark):
    """A hot group and a NULL group equal Spark's own windows."""
    from quarry.operators.ranking import moving_frame, shifted
    from quarry.operators.timeseries import sessionize
    df = _data(spark).withColumn("g", F.when(F.col("id") % 4 != 1, F.col("g")))
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("g").orderBy("v", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ours = ranked(df, order, ["g"], row_number="rn", rank="rk", dense_rank="dr", ntile=("nt", 3), running=[("sum", "v", "rs")])
    ref = df.select("id", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(3).over(w).alias("nt"), F.sum("v").over(upto).alias("rs"))
    cols = ["id", "rn", "rk", "dr", "nt", "rs"]
    assert sorted(map(tuple, ours.select(*cols).collect())) == sorted(map(tuple, ref.select(*cols).collect()))
    got = shifted(df, order, ["g"], [(["id"], 1, "p_"), (["v"], -1, "n_")]).select("id", "p_id", "n_v").collect()
    want = df.select("id", F.lag("id").over(w).alias("p"), F.lead("v").over(w).alias("n")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want), key=lambda r: r[0])
    got = moving_frame(df, order, ["g"], "v", -3, 0, ["id"], "ma").select("id", F.round("ma", 9)).collect()
    want = df.select("id", F.round(F.avg("v").over(w.rowsBetween(-3, 0)), 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    med = {r["g"]: r["p50"] for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert med == {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    ev = df.select("g", F.timestamp_seconds((F.col("v") * 1800).cast("long")).cast("timestamp_ntz").alias("ts"), "id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("g").orderBy("ts", "id")))
    start = ev.withColumn("s", F.when(gap.isNull() | (gap > 900), 1).otherwise(0))
    want = start.select("id", F.sum("s").over(Window.partitionBy("g").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, sessionize(ev, "g", "ts", "id", 900).select("id", "session_no").collect())) == sorted(map(tuple, want.collect()))


def test_halo_windows_over_many_small_blocks(spark):
    """Frames that reach over blocks and partitions, in a group of most rows and in single-row groups."""
    from quarry.operators.ranking import halo_windows
    df = spark.range(700).select("id", F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, F.col("id")).alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    order = [F.col("v"), F.col("id")]

    def columns(w):
        return {"a": F.sum("v").over(w.rowsBetween(-3, 2)), "b": F.lag("id", 3).over(w), "c": F.lead("id", 2).over(w), "d": F.count("v").over(w.rowsBetween(-3, -1))}

    got = halo_windows(df, order, ["g"], 3, 2, columns, block=20)
    w = Window.partitionBy("g").orderBy(*order)
    want = df.select("*", *[c.alias(n) for n, c in columns(w).items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert halo_windows(df.where("false"), order, ["g"], 1, 0, columns, block=20).count() == 0


def test_quantiles_by_selection_and_by_fallback(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.exp((F.col("id") * 7919) % 5000 / 200.0)).alias("v"))
    probs = [0.0, 0.01, 0.5, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()}
    for accuracy in (2, 10, 100, 10_000):  # coarse sketches bound the positions badly
        got = {r["g"]: [r[f"x{i}"] for i in range(5)] for r in exact_quantiles(df, "v", probs, ["g"], [f"x{i}" for i in range(5)], accuracy).collect()}
        assert set(got) == set(want) and all(math.isclose(x, y, rel_tol=1e-12) for g in want for x, y in zip(got[g], want[g]))

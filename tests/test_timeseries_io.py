"""Sessionization, date semantics, generator invariants, corpus reader."""

import datetime as dt
import os

from pyspark.sql import functions as F

from quarry.functions import boundary_diff, iso_weekday, start_of_week
from quarry.operators.timeseries import session_table
from quarry.session import scratch_path
from quarry.sources.generator import alias_table, generate
from quarry.sources.jsonlogs import read_corpus


def test_sessions(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [(1, t0, 1, "view"), (2, t0 + dt.timedelta(minutes=20), 1, "purchase"),
            (3, t0 + dt.timedelta(hours=3), 1, "view"), (4, t0, 2, "click")]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    s = {(r["user_id"], r["session_no"]): r for r in session_table(ev, 3600).collect()}
    assert len(s) == 3
    assert s[(1, 1)]["event_count"] == 2 and s[(1, 1)]["is_converted"] == 1 and s[(1, 1)]["exit_type"] == "purchase"
    assert s[(1, 2)]["event_count"] == 1 and s[(1, 1)]["duration_seconds"] == 1200


def test_date_semantics(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 59), dt.datetime(2024, 1, 8, 0, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(boundary_diff("hour", "a", "b").alias("h"), boundary_diff("day", "a", "b").alias("d"),
                  iso_weekday("a").alias("wd"), start_of_week("a").alias("w")).first()
    assert r["h"] == 1 and r["d"] == 1 and r["wd"] == 7 and r["w"] == dt.date(2024, 1, 1)


def test_generator_invariants(spark):
    cust, part = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("customer", "part"))
    users, products, sessions, events = generate(cust, part)
    assert users.count() == cust.count() and products.count() == part.count()
    j = events.join(sessions.select("session_id", "start_time", "duration_seconds", F.col("user_id").alias("su")),
                    "session_id")
    bad = j.where((F.col("timestamp") < F.col("start_time")) | (F.col("user_id") != F.col("su"))).count()
    assert bad == 0
    mix = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert mix["page_view"] > mix["click"] > mix["purchase"]
    again = generate(cust, part)[3]
    assert sorted(map(str, events.collect())) == sorted(map(str, again.collect()))
    empty = generate(cust.where("false"), part.where("false"))
    assert [df.count() for df in empty] == [0, 0, 0, 0]


def test_alias_table_keeps_weights():
    for weights in ([1], [60, 25, 10, 3, 2], [5, 5, 5], [0, 1, 0, 7], [1e-9, 1]):
        keep, other = alias_table(weights)
        got = [0.0] * len(weights)
        for i, (k, o) in enumerate(zip(keep, other)):
            got[i] += k / len(weights)
            got[o] += (1 - k) / len(weights)
        assert all(abs(g - w / sum(weights)) < 1e-12 for g, w in zip(got, weights))


def test_corpus_both_roots(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    path = scratch_path(spark, "corpus-test")
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/a.json", "w") as f:
        f.write('{"queries": [{"id": 1, "dataset": "x"}, {"id": 2, "dataset": "y"}]}')
    with open(f"{path}/b.json", "w") as f:
        f.write('[{"id": 3, "dataset": "x"}]')
    rec = StructType([StructField("id", LongType()), StructField("dataset", StringType())])
    ids = sorted(r["id"] for r in read_corpus(spark, path, rec, dataset="x").collect())
    assert ids == [1, 3]

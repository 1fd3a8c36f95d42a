"""Time-series recipes: calendar buckets, sessionization, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import iso_weekday, start_of_month, start_of_week
from quarry.operators.joins import broadcast_if_small
from quarry.operators.ranking import null_safe_join, sorted_rows


def calendar_counts(df: DataFrame, ts: str) -> DataFrame:
    """Counts per calendar bucket for nine bucket kinds in ONE aggregation:
    every row emits its nine (kind, bucket) labels, so the table is scanned
    and shuffled once (map-side partial counts) instead of nine times."""
    c = F.col(ts)
    labels = F.array(
        F.struct(F.lit("minute").alias("kind"), F.date_format(c, "yyyy-MM-dd HH:mm").alias("bucket")),
        F.struct(F.lit("hour_of_day").alias("kind"), F.hour(c).cast("string").alias("bucket")),
        F.struct(F.lit("day").alias("kind"), F.date_format(c, "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("iso_weekday").alias("kind"), iso_weekday(c).cast("string").alias("bucket")),
        F.struct(F.lit("week").alias("kind"), F.date_format(start_of_week(c), "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("month").alias("kind"), F.date_format(start_of_month(c), "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("month_num").alias("kind"), F.month(c).cast("string").alias("bucket")),
        F.struct(F.lit("year").alias("kind"), F.year(c).cast("string").alias("bucket")),
        F.struct(F.lit("yyyymm").alias("kind"), F.date_format(c, "yyyyMM").alias("bucket")),
    )
    return (df.select(F.inline(labels)).groupBy("kind", "bucket").agg(F.count("*").alias("n")))


def sessionize(df: DataFrame, user: str, ts: str, tiebreak: str, gap_seconds: int) -> DataFrame:
    """Gap-based sessions: a new session starts when the gap to the user's
    previous event exceeds ``gap_seconds``.  Adds ``session_no`` (1-based per
    user).

    Skew-safe in one pass: events are range-partitioned on (user, time), so a
    user holding a third of all events spans many tasks; the first event of a
    user in a task compares with the user's last event of the tasks before
    it, and session starts are counted per task and completed by the counts
    of those tasks.  Events without a user are one group."""
    order = [F.col(ts), F.col(tiebreak)]
    d = sorted_rows(df, [F.col(user), *order]).drop("_at")
    local = Window.partitionBy("_pid", user).orderBy(*order)
    before = Window.partitionBy(user).orderBy("_pid")
    # one row per (task, user): at most users + tasks
    last = d.groupBy("_pid", user).agg(F.max(ts).alias("_last")).withColumn("_carry", F.lag("_last").over(before)).drop("_last")
    d = null_safe_join(d.withColumn("_prev", F.lag(ts).over(local)), broadcast_if_small(last), ["_pid", user])
    d = d.withColumn("_prev", F.coalesce("_prev", "_carry")).drop("_carry")
    gap = F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts))   # zone-free on timestamp_ntz
    d = d.withColumn("_start", F.when(F.col("_prev").isNull() | (gap > F.lit(gap_seconds * 1_000_000)), 1).otherwise(0)).drop("_prev")
    d = d.withColumn("_n", F.sum("_start").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    starts = (d.groupBy("_pid", user).agg(F.sum("_start").alias("_s"))
              .withColumn("_earlier", F.coalesce(F.sum("_s").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s"))
    d = null_safe_join(d, broadcast_if_small(starts), ["_pid", user])
    return d.withColumn("session_no", F.col("_earlier") + F.col("_n")).drop("_pid", "_start", "_n", "_earlier")


def session_table(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Sessions from raw events — start, end, length, event count,
    entry and exit event type, converted flag."""
    s = sessionize(events, "user_id", "ts", "event_id", gap_seconds)
    first_key = F.struct("ts", "event_id")
    return s.groupBy("user_id", "session_no").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1_000_000).alias("duration_seconds"),
        F.count("*").alias("event_count"),
        F.min_by("event_type", first_key).alias("entry_type"),
        F.max_by("event_type", first_key).alias("exit_type"),
        F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("is_converted"))

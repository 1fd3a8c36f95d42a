"""Event streams: watermark + windowed counts, gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream (explicit schema);
    ``ts`` becomes the event-time column."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("event_time", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """R1 on a stream: counts per tumbling window and event type; late rows
    within the watermark update their window, older ones are dropped."""
    return (stream.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", window).alias("w"), "event_type")
            .agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n"))


def session_counts(stream: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """R14 on a stream: gap-based sessions per user with Spark's session windows."""
    return (stream.withWatermark("event_time", watermark)
            .groupBy("user_id", F.session_window("event_time", gap).alias("s"))
            .agg(F.count("*").alias("event_count"),
                 F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("is_converted"))
            .select("user_id", F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"),
                    "event_count", "is_converted"))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finalised rows to parquet; the checkpoint (on the shared
    checkpoint filesystem) makes the query restartable after failures."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

"""Sinks: report files (IO6), batched parquet writes (IO7) and the
month-partitioned, sorted layout (IO8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """IO6: CSV (with header) or JSON lines; written by the executors."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)


def write_batched(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """IO7: parquet with at most ``rows_per_file`` rows per file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_month_layout(df: DataFrame, path: str, ts: str, sort_cols: list[str]) -> None:
    """IO8: ``PARTITION BY yyyymm(ts) ORDER BY (sort_cols)``: one folder per
    month, rows clustered by month and sorted inside each file, so a month
    filter prunes folders and the sort keys give tight parquet min/max stats."""
    d = df.withColumn("ym", F.date_format(ts, "yyyyMM").cast("int"))
    # range partitions over month and sort keys: a large month spans several tasks and files
    (d.repartitionByRange("ym", *sort_cols).sortWithinPartitions("ym", *sort_cols)
     .write.mode("overwrite").partitionBy("ym").parquet(path))


def write_calendar(df: DataFrame, path: str, ts: str) -> None:
    """Calendar dimension of a fact table: one row a month that occurs (d_month as yyyymm, d_year, d_quarter), by
    which filters on years and quarters prune the folders of the month layout."""
    (df.where(F.col(ts).isNotNull()).select(F.date_format(ts, "yyyyMM").cast("int").alias("d_month"), F.year(ts).alias("d_year"), F.quarter(ts).alias("d_quarter"))
     .distinct().coalesce(1).write.mode("overwrite").parquet(path))

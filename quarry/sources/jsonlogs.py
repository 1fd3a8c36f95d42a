"""JSON run logs and query corpora (IO4, IO5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, StringType

from quarry.session import scratch_path

CORRUPT = "_corrupt_record"


def read_run_log(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """IO4: JSON-lines run log; malformed lines are kept aside, not fatal.

    Returns ``(good_rows, rejected_lines)``; both are lazy DataFrames, so a
    caller counts rejects with an aggregate instead of a driver loop."""
    full = StructType(schema.fields + [StructField(CORRUPT, StringType(), True)])
    raw = (spark.read.schema(full).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    # Spark refuses scans that reference only the corrupt-record column, and
    # column pruning would reduce the reject count to exactly that; the
    # documented remedy is to save the parsed rows and query the saved result.
    parsed = scratch_path(spark, "run-log")
    raw.write.parquet(parsed)
    raw = spark.read.parquet(parsed)
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def read_corpus(spark: SparkSession, path: str, record: StructType, dataset: str | None = None) -> DataFrame:
    """IO5: query-corpus files whose root is either a list of records or an
    object ``{"queries": [...]}``; one record per row, optional dataset filter.
    Files are read whole (multiLine) but in parallel across files."""
    text = spark.read.option("wholetext", "true").text(path)
    as_obj = F.from_json("value", StructType([StructField("queries", ArrayType(record))]))
    as_list = F.from_json("value", ArrayType(record))
    recs = text.select(F.explode(F.when(F.ltrim("value").startswith("["), as_list)
                                 .otherwise(as_obj["queries"])).alias("q")).select("q.*")
    return recs.where(F.col("dataset") == dataset) if dataset else recs

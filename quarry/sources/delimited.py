"""Delimited-text loaders with explicit schemas (IO2, IO3).

Schemas are declared, never inferred; gzip files are not splittable, so a
load of compressed text is repartitioned right after the scan when asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_delimited(df: DataFrame, path: str, sep: str, compression: str | None = None) -> None:
    w = df.write.mode("overwrite").option("sep", sep).option("header", "false")
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str,
                   repartition: int | None = None) -> DataFrame:
    """IO2/IO3: ``sep='\\t'`` for TSV, ``'|'`` for pipe files.  Malformed
    lines fail the job (FAILFAST) rather than silently turning into NULLs."""
    df = (spark.read.schema(schema).option("sep", sep).option("header", "false")
          .option("mode", "FAILFAST").csv(path))
    return df.repartition(repartition) if repartition else df

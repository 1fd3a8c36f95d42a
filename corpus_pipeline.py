"""Training-corpus pipeline over ``documents``: quality, language, near
duplicates, benchmark contamination, packing.

Each stage is ``(name, function(spark, docs, sf_dir))``; ``run`` writes a
stage's rows as Parquet in the shared folder and reads them again as the
next one's documents.  The first four return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, ngram_join, packing, quality
from quarry.llm.queries import vocabulary
from quarry.session import scratch_path

#: tables of rejected rows up to this many (an id and 16 bytes each) are broadcast, larger ones are joined by a shuffle
BROADCAST_ROWS = 1_000_000
#: column that tells rows of one doc_id apart inside a stage
TEXT_KEY = "_text_key"
#: number and key of a row inside the near-duplicate stage
ROW, KEY = "_row", "_row_key"
#: texts in a batch for Python workers, in bytes and in rows
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1024
#: word pieces that a worker of the packing stage remembers, beside what the stages before have left in its executor
CACHE_PIECES = 60_000


def _small_batches(spark: SparkSession) -> None:
    """From here on texts go to Python workers a few megabytes at a time: a batch lies in the JVM, in Arrow and in
    Python at once, and what a worker has taken for a large one it keeps through the stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _without(spark: SparkSession, docs: DataFrame, rejected: DataFrame, name: str, *keys: str) -> DataFrame:
    """``docs`` without the rows whose columns ``keys`` are in ``rejected``; a null matches a null."""
    path = scratch_path(spark, name)
    rejected.select(*(F.col(k).alias(f"_gone_{k}") for k in keys)).distinct().write.parquet(path)
    gone = spark.read.parquet(path)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = [docs[k].eqNullSafe(gone[f"_gone_{k}"]) for k in keys]
    return docs.join(gone, reduce(and_, same), "left_anti")


def _without_texts(spark: SparkSession, docs: DataFrame, rejected: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``docs`` without the rejected rows, told apart by doc_id and a 128-bit digest of the text: a verdict hangs
    on the text alone, and rows that share an id (or have none) may have different texts."""
    _small_batches(spark)
    marked = docs.withColumn(TEXT_KEY, F.unhex(F.md5(F.col("text").cast("binary"))))
    return _without(spark, marked, rejected(marked), name, "doc_id", TEXT_KEY).drop(TEXT_KEY)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return _without_texts(spark, docs, lambda d: quality.score_quality(d, carry=TEXT_KEY).where(~F.col("kept")), "pipeline-quality")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough certainty."""
    return _without_texts(spark, docs, lambda d: langid.identify_languages(d, carry=TEXT_KEY).where(~F.col("accepted")), "pipeline-language")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (rows without an id, and further rows
    of one id, come behind all others).

    Every row is a document: of rows that share an id, or have none, different
    texts all stay and equal ones leave one row.
    """
    _small_batches(spark)
    keyed = _one_key_a_row(spark, docs)
    found = ngram_join.jaccard_components(keyed.select(F.col(KEY).alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(KEY))
    return _without(spark, keyed, gone, "pipeline-distinct", KEY).drop(KEY)


def _one_key_a_row(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row: the doc_id, and for rows without one and repeated ids a number
    beyond all ids, given in a written table."""
    total, unique = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total == unique:
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    path = scratch_path(spark, "pipeline-rows")
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(ROW).alias("_first"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    path = scratch_path(spark, "pipeline-extra-rows")
    (rows.select("doc_id", ROW).join(first, "doc_id", "left").where(F.col("_first").isNull() | (F.col(ROW) != F.col("_first")))
     .select(F.col(ROW).alias("_extra")).write.parquet(path))
    extra = spark.read.parquet(path)
    extra = F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra
    if (high or 0) < 1 << 61:
        number = F.lit((high or 0) + 1) + F.col("_extra") + F.when(F.col("doc_id").isNull(), F.lit(1 << 60)).otherwise(F.lit(0))
    elif low > -(1 << 62):
        number = F.lit(low - 1) - F.col("_extra")
    else:  # ids fill the whole range
        return rows.withColumn(KEY, F.col(ROW)).drop(ROW)
    return rows.join(extra, F.col(ROW) == F.col("_extra"), "left").withColumn(KEY, F.coalesce(number, F.col("doc_id").cast("long"))).drop(ROW, "_extra")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _without_texts(spark, docs, lambda d: decontaminate.contaminated_words(d, bench, carry=TEXT_KEY).where("contaminated"), "pipeline-benchmark")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), cache_pieces=CACHE_PIECES)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("packing", pack),
]

#: trained models and tokenizers are not SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

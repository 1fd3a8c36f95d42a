"""Sequence packing: first-fit decreasing on a tournament tree (operator 10).

Every text is encoded whole, its ids cut into full sequences and one rest.
Rests are dealt at random into groups of about ``group_docs`` documents;
inside a group they are placed longest first into the first sequence with
room, found by descending a tree whose inner nodes hold the largest room
below them.  A group is bounded whatever the input's size, and groups are
independent, so the work spreads over all tasks and a lost task redoes its
groups only.

A null or empty text is the end id alone.  Rows keep their multiplicity
(repeated rows are dealt to groups by their place in the token table).
Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import CACHE_PIECES, encoder, text_groups
from quarry.session import scratch_path


class RoomTree:
    """Tournament tree over the room left in sequences 0..n-1."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first sequence with room; its number."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        leaf = i - self.leaves
        while i > 1:
            i //= 2
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size (0 < size <= capacity)."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, used = RoomTree(max(1, len(sizes)), capacity), [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        b = tree.first_fit(s)
        where[i], offset[i] = b, used[b]
        used[b] += s
    return where, offset


def _lengths(tokenizer: str, end_id: int, capacity: int, cache_pieces: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, cache_pieces), np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in text_groups(texts):
                n, crc = [], []
                for ids in enc.encode(texts[first:last]):
                    ids += end
                    n.append(len(ids) // 4)
                    crc.append([zlib.crc32(ids[i:i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array[first:last], "doc_tokens": n, "crcs": crc})
    return run


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        n = pdf["doc_tokens"].to_numpy()
        pieces = -(-n // capacity)
        full, rest = n // capacity, n % capacity
        has = rest > 0
        where, offset = first_fit_decreasing(rest[has], capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = k == full[row]  # the rest; full pieces are sequences of their own
        seq, off = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        seq[last], off[last] = where, offset
        seq[~last] = (where.max() + 1 if len(where) else 0) + np.arange((~last).sum())
        crcs = np.concatenate([np.asarray(c, dtype=np.int64) for c in pdf["crcs"]])
        return pd.DataFrame({"doc_id": pdf["doc_id"].array.take(row), "start": k * capacity, "length": np.where(last, rest[row], capacity),
                             "ids_crc32": crcs, "doc_tokens": n[row], "sequence_id": (int(pdf["grp"].iloc[0]) << 32) + seq, "offset": off})
    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_docs: int = 8192, seed: int = 17,
                   cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``cache_pieces``: word pieces that a worker remembers the ids of; fewer cost time, more memory.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pack-lengths")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .mapInPandas(_lengths(tokenizer, end_id, capacity, cache_pieces), "doc_id long, doc_tokens long, crcs array<long>")
     .withColumn("row", F.monotonically_increasing_id()).write.parquet(path))
    lengths = spark.read.parquet(path)
    groups = max(1, -(-lengths.count() // group_docs))
    return (lengths.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
            .groupBy("grp").applyInPandas(
                _pack(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))

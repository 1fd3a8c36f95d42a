"""Token ids in bit-packed files (operator 3).

A file holds the ids of consecutive documents, each id in the vocabulary's
minimum number of bits.  Ids are packed in blocks of ``BLOCK_IDS``; a block
starts at a byte offset listed in the footer, so any run of ids is read by
its blocks alone and unpacked with a few numpy operations.

    blocks | block offsets u64 | document ids i64 | null flags u8
    | first id of each document u64 (one more than documents) | trailer

The trailer (fixed size, at the end) has the counts, the width and the
magic.  Documents are range-partitioned and sorted by id; each task writes
one file in the shared folder under a name of its own attempt, and the
manifest, written by Spark, lists the attempts that count.  A lost executor
leaves at most an unlisted file.

A null or empty text has only the end id; a null ``doc_id`` sorts first;
repeated ids are ordered by a hash of the text.  An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import encoder, text_groups
from quarry.session import scratch_path

BLOCK_IDS = 4096
_TRAILER = struct.Struct("<QQQHH4s")  # documents, ids, start of the footer, width, zero, magic
_MAGIC = b"TKB1"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, least significant bit first, padded to a byte."""
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """First ``n`` ids of a packed block."""
    words = np.frombuffer(data + b"\0" * (16 - len(data) % 8), dtype="<u8")
    at = np.arange(n, dtype=np.uint64) * np.uint64(width)
    w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(s > 0, words[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
    return (((words[w] >> s) | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Append documents in order; ids are flushed block by block."""

    def __init__(self, uri: str, width: int):
        where, path = _open(uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = where.open_output_stream(path), width
        self.buffer, self.held, self.n_ids, self.pos = [], 0, 0, 0
        self.offsets, self.ids, self.nulls, self.starts = [], [], [], [0]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.pos)
        self.out.write(data)
        self.pos += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(ids[i:min(whole, i + BLOCK_IDS)])
        self.buffer, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        foot = self.pos
        for a, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.out.write(np.array(a, dtype=kind).tobytes())
        self.out.write(_TRAILER.pack(len(self.ids), self.n_ids, foot, self.width, 0, _MAGIC))
        self.out.close()


class TokenFile:
    """Random access to a file's documents and ids."""

    def __init__(self, uri: str):
        where, path = _open(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        self.n_docs, self.n_ids, foot, self.width, _, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n_blocks = -(-self.n_ids // BLOCK_IDS)
        data = self.file.read_at(size - _TRAILER.size - foot, foot)
        at = 0
        out = []
        for n, kind in ((n_blocks, "<u8"), (self.n_docs, "<i8"), (self.n_docs, "u1"), (self.n_docs + 1, "<u8")):
            out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += out[-1].nbytes
        self.offsets, self.doc_ids, self.nulls, self.starts = out
        self.ends = np.append(self.offsets[1:], np.uint64(foot)) if n_blocks else self.offsets

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids at positions first..last-1, reading only their blocks."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK_IDS, (last - 1) // BLOCK_IDS
        base = int(self.offsets[a])
        data = self.file.read_at(int(self.ends[b]) - base, base)
        parts = [unpack(data[int(self.offsets[k]) - base:int(self.ends[k]) - base], min(BLOCK_IDS, self.n_ids - k * BLOCK_IDS), self.width)
                 for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * BLOCK_IDS:last - a * BLOCK_IDS]

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part, writer, uri = encoder(tokenizer), TaskContext.get().partitionId(), None, ""
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in text_groups(texts):
                for doc, ids in zip(pdf["doc_id"].tolist()[first:last], enc.encode(texts[first:last])):
                    if writer is None:
                        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.tkb"
                        writer = TokenFileWriter(uri, max(enc.width, end_id.bit_length()))
                    writer.add(None if doc is None or doc != doc else int(doc), np.frombuffer(ids + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"part": [part], "uri": [uri], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids]})
    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode every text, write token files in ascending doc_id order; the manifest (part, uri, n_docs, n_ids)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    manifest = f"{folder}/manifest"
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInPandas(_write(folder, tokenizer, end_id), "part int, uri string, n_docs long, n_ids long").write.parquet(manifest))
    return spark.read.parquet(manifest)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for uri, base in zip(pdf["uri"], pdf["base"]):
            f = TokenFile(uri)
            starts = f.starts.astype(np.int64)
            first = 0
            while first < f.n_docs:  # about a million ids at a time, or one longer document
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 20), side="right")) - 1)
                ids = f.ids(int(starts[first]), int(starts[last])).astype("<u4")
                s = starts[first:last + 1] - starts[first]
                yield pd.DataFrame({
                    "doc_id": pd.array(f.doc_ids[first:last], dtype="Int64").copy() if not f.nulls[first:last].any()
                    else pd.array([None if z else int(x) for x, z in zip(f.doc_ids[first:last], f.nulls[first:last])], dtype="Int64"),
                    "start": base + starts[first:last], "n_tokens": np.diff(s),
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s[:-1], s[1:])]})
                first = last
            f.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark, base, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("part").collect():  # one row per file
        rows.append((r["uri"], base))
        base += r["n_ids"]
    files = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))
    return files.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Vectorised hashing of words and word runs over Arrow batches of text.

A batch of texts is one byte buffer.  A 256-entry table maps every byte to
itself, to its lower case or to a separator, and a polynomial prefix sum
modulo 2^64 gives the hash of any byte range in constant time, so words,
word n-grams and byte n-grams need no Python loop.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: texts are cut into sub-batches of about this many bytes (numpy needs ~60 bytes per text byte)
CHUNK_BYTES = 1 << 20


def byte_table(separators: bytes) -> bytes:
    """Translation table: A-Z to a-z, ``separators`` to a space, the rest unchanged."""
    t = bytearray(range(256))
    for c in range(65, 91):
        t[c] = c + 32
    for c in separators:
        t[c] = 32
    return bytes(t)


#: words [^\x20\x09-\x0D]+ after lower-casing A-Z
SPACE_WORDS = byte_table(bytes([9, 10, 11, 12, 13, 32]))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, _INV, dtype=np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2^64 for i < n (sizes rounded up and cached)."""
    up, down = _powers(max(1 << 21, 1 << int(n).bit_length()))
    return up[:n], down[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums ``H`` with ``hash(i, j) = (H[j] - H[i]) * base**-i``."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: what forgets the caches of stages that a worker process may have run before
FORGET: list[Callable[[], None]] = []


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def settle() -> None:
    """Give back the memory that earlier work of this process left behind: caches of other stages, freed arrays."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def cut_text(text, limit: int) -> list:
    """The text (str or bytes) in parts of about ``limit``, cut before white space; a longer word is not cut."""
    out, at = [], 0
    marks = (" ", "\n", "\t") if isinstance(text, str) else (b" ", b"\n", b"\t")
    while len(text) - at > limit:
        end = max(text.rfind(m, at + 1, at + limit) for m in marks)
        if end < 0:
            end = min((e for e in (text.find(m, at + limit) for m in marks) if e >= 0), default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def text_blocks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list]]:
    """Row numbers and texts (None: empty) of about ``limit`` in all; a longer text comes in parts, each under its row's number."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in [t] if t is None or len(t) <= limit else cut_text(t, limit):
            n = len(part) if part is not None else 0
            if size and size + n > limit:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += n + 1
    if rows:
        yield np.array(rows), parts


def sub_batches(texts: pd.Series, max_bytes: int = CHUNK_BYTES):
    """Yield (first, last) row ranges whose texts total about ``max_bytes`` (one longer text is a range of its own)."""
    settle()
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > max_bytes:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of ``texts`` (bytes or None), in order, and
    the word offsets of each text (``len(texts) + 1`` entries).  A long text
    is read in blocks, so that only its words' hashes are held at once."""
    rows = [t if t is not None else b"" for t in texts]
    if sum(map(len, rows)) <= 2 * CHUNK_BYTES:
        return _words_of(rows, table)
    found, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(rows) + 1, dtype=np.int64)
    for i, row in enumerate(rows):
        for part in cut_text(row.translate(table), CHUNK_BYTES):  # separators are spaces now
            h, _ = _words_of([part], table)
            found.append(h)
            counts[i + 1] += len(h)
    return np.concatenate(found), np.cumsum(counts)


def _words_of(rows: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(rows).translate(table) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff((buf != 32).view(np.int8)))
    start, end = edge[0::2] + 1, edge[1::2] + 1
    ends = np.cumsum([len(r) + 1 for r in rows])  # each text's separator, shifted by the leading space
    offsets = np.concatenate([[0], np.searchsorted(start, ends, side="left")]).astype(np.int64)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), offsets
    return range_hash(prefix_hash(buf), start, end), offsets


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (position i: words i..i+k-1)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for at in range(0, n, 1 << 20):  # a stretch at a time, for the sake of temporaries
        part = out[at:at + (1 << 20)]
        for j in range(k):
            part[:] = mix(part + words[at + j:at + j + len(part)] + np.uint64(j + 1))
    return out

"""Phrase collocations mined by SON partitioning (operator 11).

The documents are dealt into shards by a hash of their text.  A phrase that
occurs ``support`` times in all occurs more than ``floor((support - 1) * w)``
times in some shard, ``w`` being the shard's share of all words, because
these floors add up to less than ``support``.  So every shard is mined
completely at that lowered support, level by level (a phrase is looked at
only where the shorter phrases in it are frequent): tasks count hashed
phrases of their part of a shard, the parts meet by phrase with a sum a
shard, and a phrase goes on if it is locally frequent in some shard and the
shards do not already show that all its occurrences are too few.  The union
of these phrases, and the words that they begin and end with, are then
counted exactly over all documents, as text.

Between the passes the union travels as a sieve, a table of at most
``SIEVE_BITS`` bits: a phrase it holds by chance costs a row and is dropped
by the exact count, none is missed.  No task and no shard's result is ever
gathered; a shard is as many tasks as its size asks for.

Null texts are empty; a null lang is ``und``.  Texts of more than
``BLOCK_BYTES`` are read block by block with three words of overlap.  Inside
a task phrases are told apart by two 64-bit hashes and by language, between
tasks as text.  Rows keep their multiplicity, other columns are ignored, an
empty table gives no rows; ties go by phrase.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.spans import mix, prefix_hash, range_hash, runs_of
from quarry.session import scratch_path

LONGEST = 4
BLOCK_BYTES = 1 << 20
#: bits of the largest sieve (16 MB)
SIEVE_BITS = 1 << 27
#: entries that a task gathers before it passes them on
_GATHER = 1 << 20
#: phrases that a task of the exact count holds at most
_PHRASES = 1_000_000
MAX_SHARDS = 8
_PIECE, _SPACE = 10, 32
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _PIECE if c in b".,;:!?\x0a\x0b\x0c\x0d" else _SPACE if c in b" \t" else c for c in range(256))
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def blocks(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A translated text in blocks cut between words, and how many words each repeats from the block before (three, if it has them)."""
    at, end = 0, 0
    while True:
        if len(text) - end <= BLOCK_BYTES:
            cut = len(text)
        else:
            cut = max(text.rfind(b" ", end + 1, end + BLOCK_BYTES), text.rfind(b"\n", end + 1, end + BLOCK_BYTES))
            if cut < 0:
                found = [x for x in (text.find(b" ", end + BLOCK_BYTES), text.find(b"\n", end + BLOCK_BYTES)) if x >= 0]
                cut = min(found, default=len(text))
        yield text[at:cut], sum(1 for _ in text[at:end].replace(b"\n", b" ").split(b" ") if _) if at < end else 0
        if cut == len(text):
            return
        begin, words = cut, 0
        while words < LONGEST - 1 and begin > at:  # back over three words
            while begin > at and text[begin - 1] in (_PIECE, _SPACE):
                begin -= 1
            if begin == at:
                break
            begin = max(text.rfind(b" ", at, begin), text.rfind(b"\n", at, begin), at - 1) + 1
            words += 1
        at, end = begin, cut


@functools.lru_cache(maxsize=1)
def _second_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _SECOND, dtype=np.uint64)
    down = np.full(n, np.uint64(pow(int(_SECOND), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of some texts: hash, piece and text of each."""

    def __init__(self, rows: list[bytes], repeated: int = 0, second: bool = False):
        self.raw = b"\n" + b"\n".join(rows) + b"\n"
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(((buf != _SPACE) & (buf != _PIECE)).view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.hash = range_hash(prefix_hash(buf), self.start, self.end)
        self.piece = np.cumsum(buf == _PIECE)[self.start]
        limits = np.cumsum([1] + [len(r) + 1 for r in rows])
        self.row = np.searchsorted(limits, self.start, side="right") - 1
        self.repeated = repeated
        if second:
            up, down = _second_powers(max(1 << 21, 1 << len(buf).bit_length()))
            h = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(7)) * up[:len(buf)], out=h[1:])
            self.other = mix((h[self.end] - h[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def phrases(self, k: int) -> np.ndarray:
        """Places of all phrases of k words that lie in one piece and are not wholly repeated."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1:])
        return at[at + k > self.repeated]

    def keys(self, k: int, langs: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Key of the k words from each place, whatever piece they lie in, with the language mixed in."""
        runs = runs_of(self.hash if words is None else words, k)
        return mix(runs ^ langs[self.row[:len(runs)]] ^ np.uint64(k << 8))

    def text(self, at: int, k: int) -> bytes:
        s = self.raw[self.start[at]:self.end[at + k - 1]]
        return b" ".join(s.split()) if k > 1 else s


def _word_batches(pdf: pd.DataFrame, second: bool = False) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of about ``BLOCK_BYTES`` of texts at a time, with the row of the batch of each of their texts."""
    rows, ids, size = [], [], 0
    for i, t in enumerate(pdf["text"]):
        if t is None:
            continue
        t = t.translate(_TABLE)
        if len(t) > BLOCK_BYTES:
            for part, repeated in blocks(t):
                yield Words([part], repeated, second), np.array([i])
            continue
        if size + len(t) > BLOCK_BYTES:
            yield Words(rows, 0, second), np.array(ids)
            rows, ids, size = [], [], 0
        rows.append(t)
        ids.append(i)
        size += len(t) + 1
    if rows:
        yield Words(rows, 0, second), np.array(ids)


def _lang_hashes(pdf: pd.DataFrame) -> np.ndarray:
    return mix(pdf["lang_key"].to_numpy().astype(np.int64).view(np.uint64))


def _held(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the sieve holds each key."""
    bit = keys & np.uint64(len(sieve) * 64 - 1)
    return (sieve[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


class _Counts:
    """Counts by (key, shard), passed on when many are gathered."""

    def __init__(self, shards: int):
        self.keys, self.n, self.size = [[] for _ in range(shards)], [[] for _ in range(shards)], 0

    def add(self, shard: int, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.keys[shard].append(u)
        self.n[shard].append(n)
        self.size += len(u)

    def merged(self) -> Iterator[pd.DataFrame]:
        for shard, (keys, n) in enumerate(zip(self.keys, self.n)):
            if keys:
                u, at = np.unique(np.concatenate(keys), return_inverse=True)
                yield pd.DataFrame({"key": u.view(np.int64), "shard": np.int8(shard), "c": np.bincount(at, weights=np.concatenate(n), minlength=len(u)).astype(np.int64)})


def _local_counts(lengths: tuple[int, ...], sieve, shards: int):
    """Counts of (phrase, shard) in a task.

    ``sieve``: the shorter phrases that may be frequent, of ``min(lengths) - 1``
    words; where these are pairs, their words come along under the number of
    shards as shard, each once a batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts(shards + 1)
        for pdf in batches:
            lang, shard = _lang_hashes(pdf), pdf["shard"].to_numpy()
            for words, ids in _word_batches(pdf):
                langs, of = lang[ids], shard[ids][words.row]
                part = min(lengths) - 1
                good = _held(sieve.value, words.keys(part, langs)) if part else None
                for k in lengths:
                    at = words.phrases(k)
                    if part:
                        fine = np.ones(len(at), bool)
                        for j in range(k - part + 1):
                            fine &= good[at + j]
                        at = at[fine]
                    if len(at):
                        keys, mine = words.keys(k, langs)[at], of[at]
                        for s in np.unique(mine):
                            counts.add(int(s), keys[mine == s])
                if part == 2:
                    at = words.phrases(2)
                    at = at[good[at]]
                    if len(at):
                        counts.add(shards, words.keys(1, langs)[np.unique(np.concatenate([at, at + 1]))])
                if counts.size > _GATHER:
                    yield from counts.merged()
                    counts = _Counts(shards + 1)
        yield from counts.merged()
    return run


def _sieve(frequent: DataFrame):
    """Broadcast bit table of the keys, 32 bits for a key up to ``SIEVE_BITS`` in all."""
    bits = min(SIEVE_BITS, max(1 << 12, 1 << int(frequent.count() * 32).bit_length()))
    slots = (frequent.select((F.col("key").bitwiseAND(F.lit(bits - 1))).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
             .toPandas())  # at most bits / 64 rows
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[slots["slot"].to_numpy(dtype=np.int64)] = slots["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(table)


def mine_shards(src: DataFrame, support: int, shards: int) -> dict[int, object]:
    """Sieves of the candidates by length (3 and 4 words share one); for single words, those that candidates begin or end with."""
    spark = src.sparkSession

    def counted(lengths, sieve=None) -> DataFrame:
        per_shard = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("c"))), F.lit(0)).alias(f"c{s}") for s in range(shards + 1)]
        return src.mapInPandas(_local_counts(lengths, sieve, shards), "key long, shard byte, c long").groupBy("key").agg(*per_shard)

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    words = written(counted((1,)), "phrases-1")
    sizes = words.agg(*[F.sum(F.col(f"c{s}").cast("decimal(38,0)")) for s in range(shards)]).first()
    whole = int(sum(x or 0 for x in sizes)) or 1
    local, total = F.lit(False), F.lit(0)
    for s, size in enumerate(sizes):
        local = local | (F.col(f"c{s}") >= (support - 1) * int(size or 0) // whole + 1)
        total = total + F.col(f"c{s}")
    candidate = local & (total >= support)
    pairs = written(counted((2,), _sieve(words.where(candidate).select("key"))).where(candidate).select("key"), "phrases-2")
    sieves = {2: _sieve(pairs)}
    ends = F.col(f"c{shards}") > 0
    longer = written(counted((3, 4), sieves[2]).where(candidate | ends).select("key", ends.alias("word")), "phrases-3-4")
    sieves[1] = _sieve(longer.where("word").select("key"))
    sieves[3] = sieves[4] = _sieve(longer.where("not word").select("key"))
    return sieves


def _exact_counts(sieves):
    """Counts of the phrases that the sieves hold, as text, and of all words (no phrase) by language."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, int] = {}
        known = _Known()
        for pdf in batches:
            lang, names = _lang_hashes(pdf), pdf["lang"].to_numpy()
            for words, ids in _word_batches(pdf, second=True):
                langs, called = lang[ids], names[ids]
                fresh = np.bincount(words.row[words.repeated:], minlength=len(ids))
                for i in np.flatnonzero(fresh):
                    totals[called[i]] = totals.get(called[i], 0) + int(fresh[i])
                for k in range(1, LONGEST + 1):
                    at = words.phrases(k)
                    keys = words.keys(k, langs)[at] if len(at) else np.zeros(0, np.uint64)
                    held = _held(sieves[k].value, keys)
                    at, keys = at[held], keys[held]
                    if len(at):
                        yield from known.add(words, k, at, keys, words.keys(k, langs, words.other)[at], called)
                if len(known.keys) > _PHRASES:
                    yield known.rows()
                    known = _Known()
        if len(known.keys):
            yield known.rows()
        if totals:
            yield pd.DataFrame({"lang": list(totals), "k": 0, "phrase": [b""] * len(totals), "f": list(totals.values())})
    return run


class _Known:
    """Phrases of a task with their counts, by two hashes."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.others = np.zeros(0, np.uint64)
        self.f = np.zeros(0, np.int64)
        self.k = np.zeros(0, np.int8)
        self.lang = np.zeros(0, dtype=object)
        self.phrase = np.zeros(0, dtype=object)

    def add(self, words: Words, k: int, at, keys, others, langs: np.ndarray) -> Iterator[pd.DataFrame]:
        u, first, back = np.unique(keys, return_index=True, return_inverse=True)
        alike = others == others[first][back]
        place = np.searchsorted(self.keys, u)
        seen = place < len(self.keys)
        seen[seen] = self.keys[place[seen]] == u[seen]
        clash = np.zeros(len(u), bool)
        clash[seen] = self.others[place[seen]] != others[first][seen]
        alike &= ~clash[back]
        if not alike.all():  # two phrases of one 64-bit hash: passed on one by one
            odd = at[~alike]
            yield pd.DataFrame({"lang": langs[words.row[odd]], "k": k, "phrase": [words.text(i, k) for i in odd], "f": 1})
        n = np.bincount(back[alike], minlength=len(u))
        self.f[place[seen]] += n[seen]
        new = np.flatnonzero(~seen)
        if len(new):
            where = at[first[new]]
            phrase = np.empty(len(new), dtype=object)
            phrase[:] = [words.text(i, k) for i in where.tolist()]
            to = place[new]  # u is sorted, so these places keep the order
            for name, values in (("keys", u[new]), ("others", others[first[new]]), ("f", n[new]), ("k", k), ("lang", langs[words.row[where]]), ("phrase", phrase)):
                setattr(self, name, np.insert(getattr(self, name), to, values))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"lang": self.lang, "k": self.k, "phrase": self.phrase, "f": self.f})


def phrase_counts(docs: DataFrame, support: int = 30, shards: int = 4) -> DataFrame:
    """lang, k, phrase, f: every phrase of 2 to 4 words with f >= support, the words that they begin and end with, and k = 0 with the number of words of each lang."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be 1 to {MAX_SHARDS}")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    src = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_key"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"),
                      F.col("text").cast("binary").alias("text"))
    sieves = mine_shards(src.select("lang_key", "shard", "text"), support, shards)
    return (src.select("lang", "lang_key", "text").mapInPandas(_exact_counts(sieves), "lang string, k int, phrase binary, f long")
            .groupBy("lang", "k", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
            .where((F.col("f") >= support) | (F.col("k") == 0)))


def _slice(first, size):
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, support: int = 30, top: int = 2000, shards: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each lang.

    A phrase's cut with the lowest score floor(2000000 a / (l + r)) counts
    (the first of equal ones); phrases inside a longer one with at least
    80 percent of their occurrences are left out.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-counts")
    phrase_counts(docs, support, shards).write.parquet(path)
    counts = spark.read.parquet(path)
    found = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = (found.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
            .select("lang", "phrase", "a", "cut", _slice(F.lit(1), F.col("cut")).alias("first"), _slice(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")))
    parts = counts.where(f"k between 1 and {LONGEST - 1}")
    best = (cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")))
    inside = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _slice(i, m)))), lambda x: x != "")
    longer = (found.where("k >= 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    kept = (best.join(longer, ["lang", "phrase"], "left").where("longest is null or 100 * longest < 80 * a")
            .select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Benchmark decontamination by winnowing (operator 5).

Of every ``window - k + 1`` consecutive k-gram hashes the smallest is kept
as a fingerprint, in documents and benchmark items alike, so every shared
span of ``window`` words shares a fingerprint.  Fingerprints are joined, and
each hit is extended: the word windows around it are compared with the
item's windows by a 128-bit digest of their words, which yields exactly the
occurrences of item windows.  Items shorter than a window are one window of
their own length, looked for at every position.

Null and empty texts have no words: zero counts, not contaminated.  Rows
keep their multiplicity; a null ``doc_id`` is a document, a null ``item_id``
hits words but is no item.  Extra columns are ignored; an empty benchmark
or document table gives zero counts or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.spans import ALNUM_WORDS, runs_of, sub_batches, words_of
from quarry.session import scratch_path

#: sides of at most this many rows are broadcast (under 100 bytes a row), larger ones are shuffled
BROADCAST_ROWS = 200_000


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash of every ``width`` consecutive ones (leftmost of ties)."""
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _written(df: DataFrame, name: str) -> DataFrame:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it is checked to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _fingerprints(k: int, window: int, short: list[int]):
    """id, text -> id, n words, fingerprints as (run length, hash, position) arrays."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in sub_batches(texts):
                words, at = words_of(texts[first:last], ALNUM_WORDS)
                grams = runs_of(words, k)
                runs = {n: runs_of(words, n) for n in short}
                hs, ps, ks = [], [], []
                for i in range(last - first):
                    a, b = at[i], at[i + 1]
                    g = grams[a:max(a, b - k + 1)]
                    p = winnow(g, window - k + 1)
                    h, kind = [g[p]], [np.full(len(p), k)]
                    p = [p]
                    for n, r in runs.items():
                        r = r[a:max(a, b - n + 1)]
                        h.append(r)
                        p.append(np.arange(len(r)))
                        kind.append(np.full(len(r), -n))
                    hs.append(np.concatenate(h).view(np.int64))
                    ps.append(np.concatenate(p).astype(np.int32))
                    ks.append(np.concatenate(kind).astype(np.int32))
                yield pd.DataFrame({"id": pdf["id"].array[first:last], "n_words": np.diff(at), "h": hs, "p": ps, "k": ks})
    return run


def _item_windows(window: int):
    """Every window of an item: length and digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["id"].array, pdf["text"]):
                words = (text or b"").translate(ALNUM_WORDS).split()
                n = min(window, len(words))
                if n:
                    d = list(dict.fromkeys(_digest(words[i:i + n]) for i in range(len(words) - n + 1)))
                    yield pd.DataFrame({"item_id": pd.array([item] * len(d), "Int64"), "len": n, "digest": d})
    return run


def _extend(window: int, k: int):
    """Documents with the positions of their hits -> digests of the windows around these."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_words, out = [], []
            for text, hits in zip(pdf["text"], pdf["hits"]):
                words = (text or b"").translate(ALNUM_WORDS).split()
                n_words.append(len(words))
                spans = set()
                for hit in hits if hits is not None else ():
                    kind, p = hit["k"], hit["p"]
                    if kind < 0:
                        spans.add((p, -kind))
                    else:
                        spans.update((s, window) for s in range(p - (window - k), p + 1))
                out.append([{"s": s, "len": n, "digest": _digest(words[s:s + n])} for s, n in sorted(spans) if s >= 0 and s + n <= len(words)])
            yield pdf.drop(columns=["text", "hits"]).assign(n_words=n_words, spans=out)
    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated; first the binary column ``carry``."""
    carried = [carry] if carry else []
    d = docs.select(*(F.col(c).cast("binary").alias(c) for c in carried), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    # hits are gathered by row: rows that share an id, or have none, have hits of their own
    d = d.withColumn("key", F.xxhash64("id", "text"))
    b = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    windows = _written(b.mapInPandas(_item_windows(window), "item_id long, len int, digest binary").distinct(), "decon-windows")
    short = sorted(r["len"] for r in windows.select("len").distinct().where(F.col("len") < window).collect())  # below window values
    prints = "id long, n_words long, h array<long>, p array<int>, k array<int>"
    each = F.explode(F.arrays_zip("h", "p", "k")).alias("x")
    item_prints = _written(b.mapInPandas(_fingerprints(k, window, short), prints).select("n_words", each)
                           # a run of a short length counts only as a whole item
                           .where((F.col("x.k") > 0) | (F.col("x.k") == -F.col("n_words")))
                           .select("x.h", "x.k").distinct(), "decon-prints")
    hits = (d.select(F.col("key").alias("id"), "text").mapInPandas(_fingerprints(k, window, short), prints).select("id", each)
            .select("id", "x.h", "x.k", "x.p").join(_small(item_prints), ["h", "k"], "left_semi")
            .groupBy("id").agg(F.collect_set(F.struct("k", "p")).alias("hits")))  # at most the document's words
    hits = _written(hits.withColumnRenamed("id", "hit_id"), "decon-hits")
    found = (d.join(_small(hits), F.col("key") == F.col("hit_id"), "left").select(*carried, F.col("id").alias("doc_id"), "text", "hits")
             .mapInPandas(_extend(window, k), "".join(f"{c} binary, " for c in carried) + "doc_id long, n_words long, spans array<struct<s:int,len:int,digest:binary>>"))
    rows = _written(found.withColumn("row", F.monotonically_increasing_id()), "decon-rows")
    inside = (rows.where(F.size("spans") > 0).select("row", F.explode("spans").alias("x")).select("row", "x.s", "x.len", "x.digest")
              .join(_small(windows), ["len", "digest"]))
    covered = F.aggregate(  # length of a union of spans sorted by start
        F.sort_array(F.collect_set(F.struct("s", "len"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["s"] + x["len"]).alias("end"),
                                (acc["n"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(acc["end"], x["s"]))).alias("n")),
        lambda acc: acc["n"])
    per_row = inside.groupBy("row").agg(
        covered.alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return (rows.select("row", *carried, "doc_id", "n_words").join(per_row, "row", "left")
            .select(*carried, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def bruteforce(text: str | None, items: dict[int, str | None], window: int = 10) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one text, for tests."""
    words = (text or "").encode().translate(ALNUM_WORDS).split()
    hit, ids = set(), set()
    for item, t in items.items():
        w = (t or "").encode().translate(ALNUM_WORDS).split()
        n = min(window, len(w))
        own = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i:i + n]) in own:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)

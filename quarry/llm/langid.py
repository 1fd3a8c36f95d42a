"""Language identification with averaged hashed subword embeddings (operator 6).

A text is the average of the embeddings of its hashed byte 3- and 4-grams
inside words (word ends included); a linear softmax maps it to a language.
Embeddings and softmax are trained by stochastic gradient descent in numpy
on a bounded sample (``quota`` rows a language).  Part of the sample stays
out of training: a temperature makes its scores probabilities, and the
rejection threshold is set on it.  Since the model is linear behind the
average, scoring uses one small table of bucket logits for whole texts.

Null texts and texts without a letter are ``und`` with score 0 and are
rejected.  Without any labelled row every text is ``und``.  Rows keep their
multiplicity; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import bounded_sample
from quarry.llm.spans import prefix_hash, range_hash, sub_batches, text_blocks

BUCKET_BITS = 15
DIMENSIONS = 16
#: letters stay, other ASCII is a word end, bytes of other scripts stay
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float


def subword_buckets(texts: list[str | None], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every subword of ``texts``."""
    rows = [(t or "").lower().encode() for t in texts]
    buf = np.frombuffer(b" " + b" ".join(rows).translate(_TABLE) + b"  ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in rows])
    prefix, inside = prefix_hash(buf), buf != 32
    buckets, owner = [], []
    for n in (3, 4):
        ok = inside[1:len(buf) - n + 2]
        for k in range(2, n - 1):
            ok = ok & inside[k:len(buf) - n + 1 + k]
        at = np.flatnonzero(ok)
        buckets.append((range_hash(prefix, at, at + n) >> np.uint64(64 - bits)).astype(np.int32))
        owner.append(np.searchsorted(ends, at + 1, side="left"))
    return np.concatenate(buckets), np.concatenate(owner)


def _mean_logits(texts: list[str | None], table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean row of ``table`` over each text's subwords, and how many these are; subwords lie in words, so a long text is added up over blocks."""
    sums, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for rows, parts in text_blocks(texts):
        b, owner = subword_buckets(parts, bits)
        at = rows[owner]
        n += np.bincount(at, minlength=len(texts))
        for j in range(table.shape[1]):
            sums[:, j] += np.bincount(at, weights=table[b, j], minlength=len(texts))
    return sums / np.maximum(n, 1)[:, None], n


def _subword_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for _, parts in text_blocks([text]):
        counts += np.bincount(subword_buckets(parts)[0], minlength=len(counts))
    b = np.flatnonzero(counts)
    return b, counts[b] / max(1, counts.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], updates: int = 15_000, rate: float = 0.5, seed: int = 3) -> LanguageModel:
    """SGD on (texts, langs); a quarter is held back for temperature and threshold."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    w, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    feats = [_subword_shares(t) for t in texts]
    order = rng.permutation(len(texts))
    n_val = len(texts) // 4
    val, fit = order[:n_val], order[n_val:]
    epochs = int(np.clip(updates // max(1, len(fit)), 6, 100))  # a small sample is seen more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            b, c = feats[i]
            if not len(b):
                continue
            h = c @ emb[b]
            p = softmax(h @ w + bias)
            p[y[i]] -= 1
            back = w @ p
            w -= step * np.outer(h, p)
            bias -= step * 0.1 * p
            emb[b] -= step * 8 * np.outer(c, back)
    table = emb @ w

    def scores(temperature):
        return softmax(np.array([feats[i][1] @ table[feats[i][0]] + bias for i in val]) / temperature)

    temperature, threshold = 1.0, 0.0
    if len(val) >= 20:
        grid = [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0]
        temperature = min(grid, key=lambda t: -np.log(np.maximum(scores(t)[np.arange(len(val)), y[val]], 1e-12)).mean())
        p = scores(temperature)
        right, top = p.argmax(axis=1) == y[val], p.max(axis=1)
        # lowest score at which at least 99.5 % of the accepted are right, while 1 % of the right ones go at most
        most = float(np.quantile(top[right], 0.01)) if right.any() else 0.0
        threshold = next((s for s in np.sort(top) if right[top >= s].mean() >= 0.995), 1.0)
        threshold = float(min(threshold, most, 0.9))
    return LanguageModel(names, table, bias, float(temperature), threshold)


def fit_language_model(docs: DataFrame, usable: Column, quota: int = 800) -> LanguageModel | None:
    """Model from ``text`` and non-null ``lang`` of the rows where ``usable``; ``quota`` rows a language."""
    rows = (docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), usable.alias("ok"))
            .where(F.col("ok") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).drop("ok"))
    sample = bounded_sample(rows, F.col("doc_id"), quota, by="lang").toPandas().sort_values(["doc_id", "text"])
    return train(sample["text"].tolist(), sample["lang"].tolist()) if len(sample) else None


def _predict(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: LanguageModel | None = model.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in sub_batches(texts):
                part = texts[first:last]
                letter = np.array([t is not None and any(map(str.isalpha, t)) for t in part])
                if m is None:
                    lang, score, sure = np.full(len(part), "und", dtype=object), np.zeros(len(part)), np.zeros(len(part), bool)
                else:
                    z, _ = _mean_logits(part, m.logits, BUCKET_BITS)
                    p = softmax((z + m.bias) / m.temperature)
                    lang = np.where(letter, np.array(m.languages, dtype=object)[p.argmax(axis=1)], "und")
                    score = np.where(letter, p.max(axis=1), 0.0)
                    sure = letter & (score >= m.threshold)
                yield pd.concat([pdf.iloc[first:last].drop(columns="text").reset_index(drop=True),
                                 pd.DataFrame({"lang_pred": lang, "score": score, "accepted": sure})], axis=1)
    return run


def held_out() -> Column:
    """Rows that no model learns from: crc32 of the doc_id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, quota: int = 800, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row; first the binary column ``carry``."""
    more = [F.col(carry).cast("binary").alias(carry)] if carry else []
    model = docs.sparkSession.sparkContext.broadcast(fit_language_model(docs, ~held_out(), quota))
    return (docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
            .mapInPandas(_predict(model), (f"{carry} binary, " if carry else "") + "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"))

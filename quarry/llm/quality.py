"""Quality classifier from weak labels (operator 2).

Heuristic labellers vote good, bad or nothing on every document.  Vote
patterns are counted over all documents in Spark; expectation-maximisation
on the counts estimates each labeller's accuracy on good and on bad
documents and the share of good ones, without any given label.  The
posterior of a document's pattern is its training label for a linear scorer
on hashed shape n-grams, fitted on a bounded sample and applied to every
whole text.

Null texts, empty ones and texts without a word get no votes; their score
is 0 and they are rejected.  Rows keep their multiplicity; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.sampling import bounded_sample
from quarry.llm.spans import SPACE_WORDS, mix, prefix_hash, range_hash, sub_batches, text_blocks, words_of

#: labeller, measure, good up to, bad from (reversed where good is the larger value); between them no vote
LABELLERS = (
    ("capitals", "upper_share", 0.20, 0.45),
    ("symbols", "symbol_share", 0.03, 0.12),
    ("shouting", "exclaim_share", 0.05, 0.20),
    ("formed words", "formed_share", 0.85, 0.60),
    ("bursts", "burst_share", 0.03, 0.15),
    ("bare symbols", "bare_share", 0.03, 0.15),
    ("stutter", "stutter_share", 0.04, 0.15),
    ("runs", "run_share", 0.01, 0.08),
    ("variety", "distinct_share", 0.35, 0.15),
    ("pairs", "pair_share", 0.60, 0.35),
    ("short words", "short_share", 0.08, 0.02),
)
BUCKET_BITS = 14
#: text worked on at a time; measures and shape n-grams take some 200 bytes a text byte
TEXT_BYTES = 1 << 18
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in (9, 13, 32) else c for c in range(256))
_LETTERS = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_ENDS = np.array([chr(c) in ".,;:?!" for c in range(256)])
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*|<>{}^~=+_\\@`[]"]] = True


def _block_counts(rows: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of bytes and words of each text."""
    size = np.array([len(r) for r in rows])
    buf = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)
    owner = np.repeat(np.arange(len(rows)), size + 1)

    def per_byte(mask):
        return np.bincount(owner[mask], minlength=len(rows))

    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    word_owner, length = owner[start], end - start

    def per_word(mask):
        return np.bincount(word_owner[mask], minlength=len(rows))

    # punctuation inside words: its number, runs of it, and whether it is one mark at the end
    punct = (buf >= 33) & (buf <= 126) & ~_LETTERS[buf]
    marks = np.concatenate([[0], np.cumsum(punct)])
    runs = np.concatenate([[0, 0], np.cumsum(punct[1:] & punct[:-1])])
    in_word = marks[end] - marks[start]
    formed = (in_word == 0) | ((in_word == 1) & _ENDS[buf[end - 1]])
    burst = runs[end] - runs[np.minimum(start + 1, end)] > 0
    return {"upper": per_byte((buf >= 65) & (buf <= 90)), "lower": per_byte(((buf >= 97) & (buf <= 122)) | (buf >= 128)), "symbols": per_byte(_SYMBOLS[buf]),
            "exclaims": per_byte(buf == 33), "short": per_word(length <= 3), "formed": per_word(formed & (in_word < length)), "bursts": per_word(burst),
            "bare": per_word(in_word == length)}


def measures(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Shares used by the labellers, one value a text (NaN without words); a long text is counted block by block."""
    rows = [t or b"" for t in texts]
    size = np.array([len(r) for r in rows])
    words, at = words_of(rows, SPACE_WORDS)
    n = np.diff(at)
    word_owner = np.repeat(np.arange(len(rows)), n)
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    thrice = np.zeros(len(words), bool)
    thrice[2:] = same[2:] & same[1:-1]
    owners = word_owner.astype(np.uint64) << np.uint64(40)
    _, once = np.unique(mix(mix(words[1:] + np.uint64(1)) ^ words[:-1] ^ owners[1:]), return_index=True)
    pairs = np.bincount(word_owner[1:][once], minlength=len(rows))
    _, once = np.unique(mix(words ^ owners), return_index=True)
    distinct = np.bincount(word_owner[once], minlength=len(rows))
    c: dict[str, np.ndarray] = {}
    for of, parts in text_blocks(rows, TEXT_BYTES):
        for k, v in _block_counts(parts).items():
            np.add.at(c.setdefault(k, np.zeros(len(rows), dtype=np.int64)), of, v)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "upper_share": c["upper"] / np.maximum(c["upper"] + c["lower"], 1),
            "symbol_share": c["symbols"] / np.maximum(size, 1) * 2,
            "exclaim_share": c["exclaims"] / np.maximum(n, 1),
            "stutter_share": np.bincount(word_owner[same], minlength=len(rows)) / np.maximum(n, 1),
            "run_share": np.bincount(word_owner[thrice], minlength=len(rows)) / np.maximum(n, 1),
            "pair_share": np.where(n >= 20, pairs / np.maximum(n, 1), np.nan),
            "distinct_share": np.where(n >= 40, distinct / np.maximum(n, 1) * np.sqrt(np.maximum(n, 1) / 40) ** 0.5, np.nan),
            "short_share": np.where(n >= 20, c["short"] / np.maximum(n, 1), np.nan),
            "formed_share": c["formed"] / np.maximum(n, 1),
            "burst_share": c["bursts"] / np.maximum(n, 1),
            "bare_share": c["bare"] / np.maximum(n, 1),
        }
    return {k: np.where(n > 0, v, np.nan) for k, v in out.items()}


def votes(texts: list[bytes | None]) -> np.ndarray:
    """texts x labellers: 1 good, 0 bad, -1 none."""
    m = measures(texts)
    out = np.full((len(texts), len(LABELLERS)), -1, dtype=np.int8)
    for j, (_, name, good, bad) in enumerate(LABELLERS):
        v = m[name]
        out[(v <= good) if good < bad else (v >= good), j] = 1
        out[(v >= bad) if good < bad else (v <= bad), j] = 0
    return out


@dataclass
class LabelModel:
    share_good: float
    right_on_good: np.ndarray  # probability that a vote is "good" on a good document
    right_on_bad: np.ndarray  # probability that a vote is "bad" on a bad document

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of "good" for vote rows."""
        good, bad = np.log(self.share_good), np.log1p(-self.share_good)
        lg = np.where(v == 1, np.log(self.right_on_good), np.where(v == 0, np.log1p(-self.right_on_good), 0)).sum(axis=1) + good
        lb = np.where(v == 0, np.log(self.right_on_bad), np.where(v == 1, np.log1p(-self.right_on_bad), 0)).sum(axis=1) + bad
        return 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Labellers start better than chance, which fixes which class is "good";
    pseudo-votes (nine right ones of ten on good documents, one of two on bad
    ones) keep probabilities inside (0, 1).
    """
    m = LabelModel(0.8, np.full(patterns.shape[1], 0.95), np.full(patterns.shape[1], 0.6))
    w = counts.astype(float)
    for _ in range(rounds):
        p = m.posterior(patterns)
        g, b = (w * p)[:, None], (w * (1 - p))[:, None]
        new = LabelModel(
            float(np.clip((g.sum() + 1) / (w.sum() + 2), 1e-3, 1 - 1e-3)),
            ((g * (patterns == 1)).sum(axis=0) + 9) / ((g * (patterns >= 0)).sum(axis=0) + 10),
            np.maximum(((b * (patterns == 0)).sum(axis=0) + 1) / ((b * (patterns >= 0)).sum(axis=0) + 2), 1e-3))
        moved = max(abs(new.share_good - m.share_good), np.abs(new.right_on_good - m.right_on_good).max(), np.abs(new.right_on_bad - m.right_on_bad).max())
        m = new
        if moved < 1e-7:
            break
    return m


def shape_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to 6) of the texts' shapes: buckets, text numbers, weights that sum to 1 a text.

    A shape has one character a run of lower-case, upper-case or digit
    characters, and other characters as they are; a word that repeats the
    word before it has a shape of its own.
    """
    rows = [(t or b"").translate(_SHAPE) for t in texts]
    buf = np.frombuffer(b"\n".join(rows) + b"\n", dtype=np.uint8)  # a text ends with a line's end, wherever it lies
    owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    run = np.concatenate([[True], (buf[1:] != buf[:-1]) | (buf[1:] == 10)])
    shape, who = buf[run], owner[run]
    prefix = prefix_hash(shape)
    buckets, texts_of = [], []
    for n in (1, 2, 3, 4, 6):
        at = np.arange(max(0, len(shape) - n + 1))
        at = at[who[at] == who[at + n - 1]]
        buckets.append((range_hash(prefix, at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        texts_of.append(who[at])
    words, at = words_of([t or b"" for t in texts], SPACE_WORDS)
    word_owner = np.repeat(np.arange(len(rows)), np.diff(at))
    if len(words) > 1:
        same = np.flatnonzero((words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])) + 1
        for bucket in range(5):  # as heavy as a word's n-grams of each length
            buckets.append(np.full(len(same), bucket))
            texts_of.append(word_owner[same])
    b, o = np.concatenate(buckets), np.concatenate(texts_of)
    total = np.bincount(o, minlength=len(rows))
    return b, o, 1.0 / np.maximum(total, 1)[o]


def shape_counts(text: bytes) -> np.ndarray:
    """A text's shape n-grams by bucket; a long one is read in blocks, without the n-grams over their cuts."""
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for _, parts in text_blocks([text], TEXT_BYTES):
        out += np.bincount(shape_features(parts)[0], minlength=len(out))
    return out


def shape_scores(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's shape n-grams, added up over blocks as in ``shape_counts``."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for rows, parts in text_blocks(texts, TEXT_BYTES):
        b, o, _ = shape_features(parts)
        total += np.bincount(rows[o], weights=weights[b], minlength=len(texts))
        n += np.bincount(rows[o], minlength=len(texts))
    return total / np.maximum(n, 1)


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        for first, last in sub_batches(texts, TEXT_BYTES):
            v = votes(texts[first:last]) + 1
            yield pd.DataFrame({"pattern": ["".join(map(str, row)) for row in v.tolist()], "n": 1}).groupby("pattern", as_index=False).sum()


def _pattern_matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[int(c) - 1 for c in p] for p in patterns], dtype=np.int8).reshape(len(patterns), len(LABELLERS))


def train_scorer(texts: list[bytes], posterior: np.ndarray, epochs: int = 30, rate: float = 40.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on shape features towards soft labels (both classes weigh the same): weights, bias."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(1 << BUCKET_BITS), 0.0
    feats = []
    for t in texts:
        counts = shape_counts(t)
        u = np.flatnonzero(counts)
        feats.append((u.astype(np.int16), (counts[u] / max(1, counts.sum())).astype(np.float32)))  # bounded by the buckets, 6 bytes each
    share = float(np.clip(posterior.mean(), 0.02, 0.98)) if len(posterior) else 0.5
    weight = posterior * 0.5 / share + (1 - posterior) * 0.5 / (1 - share)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            u, x = feats[i]
            p = 1 / (1 + np.exp(-np.clip(w[u] @ x + bias, -30, 30)))
            g = (posterior[i] - p) * min(weight[i], 4.0)
            w[u] += step * g * x
            bias += 0.002 * step * g
        w *= 1 - 1e-3
    return w, bias


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit_quality_model(docs: DataFrame, quota: int = 3000) -> QualityModel | None:
    """Label model from the vote counts of all documents, scorer from about ``quota`` documents."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    counts = (src.select("text").mapInPandas(_vote_rows, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
              .orderBy("pattern").toPandas())  # at most 3 ^ 11 patterns
    if not len(counts):
        return None
    labels = fit_label_model(_pattern_matrix(counts["pattern"].tolist()), counts["n"].to_numpy())
    sample = bounded_sample(src, F.xxhash64("doc_id", "text"), quota).toPandas().sort_values(["doc_id", "text"])
    texts = sample["text"].tolist()
    if not texts:
        return QualityModel(labels, np.zeros(1 << BUCKET_BITS), 0.0)
    v = np.concatenate([votes(texts[first:last]) for first, last in sub_batches(texts, TEXT_BYTES)])  # a megabyte of text at a time
    return QualityModel(labels, *train_scorer(texts, labels.posterior(v)))


def _score(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: QualityModel | None = model.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, last in sub_batches(texts, TEXT_BYTES):
                part = texts[first:last]
                v = votes(part)
                empty = np.array([not (t or b"").split() for t in part])
                if m is None:
                    score, post = np.zeros(len(part)), np.zeros(len(part))
                else:
                    z = shape_scores(part, m.weights) + m.bias
                    score = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                    post = np.where(empty, 0.0, m.labels.posterior(v))
                yield pd.DataFrame({**{c: pdf[c].array[first:last] for c in pdf.columns if c != "text"}, "votes_good": (v == 1).sum(axis=1), "votes_bad": (v == 0).sum(axis=1),
                                    "posterior": post, "score": score, "kept": score >= 0.5})
    return run


def score_quality(docs: DataFrame, quota: int = 3000, carry: str | None = None) -> DataFrame:
    """doc_id, votes_good, votes_bad, posterior (label model), score (scorer), kept of every row; first the binary column ``carry``."""
    more = [F.col(carry).cast("binary").alias(carry)] if carry else []
    model = docs.sparkSession.sparkContext.broadcast(fit_quality_model(docs, quota))
    return (docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInPandas(_score(model), (f"{carry} binary, " if carry else "") + "doc_id long, votes_good long, votes_bad long, posterior double, score double, kept boolean"))

"""Collocations against plain Python counts."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quarry.llm import collocations as co

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _counts(docs):
    """{(lang, words): f} of 1 to 4 words, and {lang: n}."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def _plain(docs, support, top):
    f, n = _counts(docs)
    cand = {x: a for x, a in f.items() if a >= support and len(x[1]) > 1}
    longest = {}
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longest[lang, w[i:i + m]] = max(a, longest.get((lang, w[i:i + m]), 0))
    out = {}
    for (lang, w), a in cand.items():
        if 100 * longest.get((lang, w), 0) >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:c]] + f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def _docs(seed=1, n=120):
    r = random.Random(seed)
    vocab = ["the", "The", "of", "é", "ÉA", "new", "york", "city", "hall", "a\x1cb", "-", "x'y", "日本", "z"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "; "]
    out = []
    for _ in range(n):
        words = [r.choice(vocab) if r.random() < 0.7 else "new york city hall" for _ in range(r.randint(0, 40))]
        out.append((r.choice(["en", "de", None, "und", ""]), "".join(w + r.choice(seps) for w in words)))
    return out + [("en", None), (None, ""), ("en", " . "), ("en", "new york " * 500)] + [("de", "A b, c d e f g")] * 60


@pytest.mark.parametrize("support,shards", [(5, 4), (30, 8), (1, 1)])
def test_collocations_equal_brute_force(spark, support, shards):
    docs = _docs()
    rows = [(i, lang, text, 1, 2, "k", 3) for i, (lang, text) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, a int, n int, k string, shard int").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(df, support, 40, shards).collect())
    assert got == _plain(docs, support, 40)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0
    df = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert co.collocations(df).count() == 0


def _exact(docs, monkeypatch=None, **patches):
    for k, v in patches.items():
        monkeypatch.setattr(co, k, v)
    every = SimpleNamespace(value=np.full(64, np.uint64((1 << 64) - 1)))
    pdf = pd.DataFrame({"lang": [x or "und" for x, _ in docs], "lang_key": [hash(x or "und") for x, _ in docs], "text": [None if t is None else t.encode() for _, t in docs]})
    f, n = Counter(), Counter()
    for part in co._exact_counts({k: every for k in (1, 2, 3, 4)})([pdf]):
        for lang, k, phrase, c in part.itertuples(index=False):
            if k:
                f[lang, tuple(phrase.decode().split(" "))] += c
            else:
                n[lang] += c
    return f, n


def test_blocks_overlap_counts_each_phrase_once(monkeypatch):
    docs = _docs(7)
    want_f, want_n = _counts([(x or "und", t) for x, t in docs])
    for size in (1, 7, 50, 400):
        f, n = _exact(docs, monkeypatch, BLOCK_BYTES=size, _PHRASES=50)
        assert f == want_f and n == +want_n
    assert _exact([("en", "x" * 300)], monkeypatch, BLOCK_BYTES=10)[0] == {("en", ("x" * 300,)): 1}


def test_equal_hashes_stay_apart(monkeypatch):
    docs = _docs(8)
    real = co.range_hash
    monkeypatch.setattr(co, "range_hash", lambda p, s, e: real(p, s, e) & np.uint64(3))  # four word hashes in all
    want_f, want_n = _counts([(x or "und", t) for x, t in docs])
    assert _exact(docs) == (want_f, +want_n)


def test_local_support_never_misses():
    """Any split of the words over shards: a phrase under every local limit is under the support."""
    r = random.Random(3)
    for _ in range(300):
        support = r.randint(1, 40)
        words = [r.randint(0, 1000) for _ in range(r.randint(1, 8))]
        total = sum(words) or 1
        limits = [(support - 1) * w // total + 1 for w in words]
        assert sum(x - 1 for x in limits) < support


def test_memory_of_a_long_text():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 2_000_000))
    pdf = pd.DataFrame({"lang": ["en"], "lang_key": [1], "shard": [0], "text": [text.encode()]})
    tracemalloc.start()
    total = 0
    for part in co._local_counts((1,), None, 1)([pdf]):
        total += part["c"].sum()
    none = SimpleNamespace(value=np.zeros(64, np.uint64))
    for part in co._exact_counts({k: none for k in (1, 2, 3, 4)})([pdf]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 2_000_000 and peak < 300e6  # whatever the text's length: blocks of a megabyte

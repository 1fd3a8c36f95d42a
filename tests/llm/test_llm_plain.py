"""Quality votes and scores, and language scores, against plain Python."""

import math
import random

import numpy as np

from quarry.llm import langid, quality, spans
from quarry.llm.langid import LanguageModel

M64 = (1 << 64) - 1
BASE = int(spans._BASE)


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def _hash(data):
    return _mix((sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(data)) + len(data)) & M64)


def _texts(n=200):
    r = random.Random(9)
    vocab = ["the", "The", "über", "Straße", "a1", "x#y", "!!", "wörd,", "end.", "?!", "--", "ÉCOLE", "12", "same", "same", "İz", "ΣΑΣ", "日本"]
    out = ["", " ", "\n\n", "one", "A B\tC\x0bD", "same same same same", "é" * 40, "x" * 300, "tail\n", "\nhead", "#$% &*| <>"]
    while len(out) < n:
        out.append("".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\n", "\t", ", "]) for _ in range(r.randint(1, 70))))
    return out


def _is_letter(b):
    return 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128


def _votes(text):
    """Votes of the labellers, in their order."""
    raw = text.encode()
    words = raw.split()
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n = len(words)
    if not n:
        return [-1] * len(quality.LABELLERS)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 or b >= 128 for b in raw)
    punct = [[33 <= b <= 126 and not _is_letter(b) for b in w] for w in words]
    distinct = len(set(low))
    m = {
        "upper_share": upper / max(upper + lower, 1), "symbol_share": sum(b in b"#$%&*|<>{}^~=+_\\@`[]" for b in raw) / len(raw) * 2, "exclaim_share": raw.count(b"!") / n,
        "formed_share": sum((sum(p) == 0 or (sum(p) == 1 and w[-1] in b".,;:?!")) and sum(p) < len(w) for w, p in zip(words, punct)) / n,
        "burst_share": sum(any(a and b for a, b in zip(p, p[1:])) for p in punct) / n, "bare_share": sum(all(p) for p in punct) / n,
        "stutter_share": sum(a == b for a, b in zip(low, low[1:])) / n, "run_share": sum(a == b == c for a, b, c in zip(low, low[1:], low[2:])) / n,
        "distinct_share": distinct / n * math.sqrt(math.sqrt(n / 40)) if n >= 40 else math.nan, "pair_share": len(set(zip(low, low[1:]))) / n if n >= 20 else math.nan,
        "short_share": sum(len(w) <= 3 for w in words) / n if n >= 20 else math.nan,
    }
    out = []
    for _, name, good, bad in quality.LABELLERS:
        v, up = m[name], good > bad
        vote = -1
        if (v >= good) if up else (v <= good):
            vote = 1
        if (v <= bad) if up else (v >= bad):
            vote = 0
        out.append(vote)
    return out


def _shape_score(text, weights):
    raw = text.encode() + b"\n"
    shape = bytearray()
    for b in raw:
        c = 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 13, 32) else b
        if not shape or shape[-1] != c or c == 10:
            shape.append(c)
    buckets = [_hash(shape[i:i + n]) >> (64 - quality.BUCKET_BITS) for n in (1, 2, 3, 4, 6) for i in range(len(shape) - n + 1)]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in text.encode().split()]
    buckets += [k for a, b in zip(low, low[1:]) if a == b for k in range(5)]
    return sum(weights[b] for b in buckets) / max(1, len(buckets))


def test_quality_votes_and_scores():
    texts = _texts()
    weights = np.random.default_rng(1).standard_normal(1 << quality.BUCKET_BITS)
    raw = [t.encode() for t in texts]
    got = quality.votes(raw)
    assert [v.tolist() for v in got] == [_votes(t) for t in texts]
    want = [_shape_score(t, weights) for t in texts]
    assert np.allclose(quality.shape_scores(raw, weights), want, atol=1e-9)
    assert np.allclose([quality.shape_scores([t], weights)[0] for t in raw], want, atol=1e-9)  # alone or in company


def test_label_model_posterior():
    model = quality.fit_label_model(np.array([_votes(t) for t in _texts()], dtype=np.int8), np.ones(200))
    for v in {tuple(_votes(t)) for t in _texts()}:
        good, bad = model.share_good, 1 - model.share_good
        for j, x in enumerate(v):
            good *= 1 if x < 0 else model.right_on_good[j] if x else 1 - model.right_on_good[j]
            bad *= 1 if x < 0 else 1 - model.right_on_bad[j] if x else model.right_on_bad[j]
        assert abs(model.posterior(np.array([v], dtype=np.int8))[0] - good / (good + bad)) < 1e-9


def test_language_scores():
    texts = _texts()
    rng = np.random.default_rng(2)
    model = LanguageModel(["a", "b", "c"], rng.standard_normal((1 << langid.BUCKET_BITS, 3)), rng.standard_normal(3), 0.7, 0.4)
    z, n = langid._mean_logits(texts, model.logits, langid.BUCKET_BITS)
    got = langid.softmax((z + model.bias) / model.temperature)
    for i, t in enumerate(texts):
        data = b" " + t.lower().encode().translate(langid._TABLE) + b"  "
        buckets = [_hash(data[k:k + size]) >> (64 - langid.BUCKET_BITS) for size in (3, 4) for k in range(len(data) - size + 1) if 32 not in data[k + 1:k + size - 1]]
        mean = sum((model.logits[b] for b in buckets), np.zeros(3)) / max(1, len(buckets))
        e = np.exp((mean + model.bias) / 0.7)
        assert n[i] == len(buckets) and np.allclose(got[i], e / e.sum(), atol=1e-9)

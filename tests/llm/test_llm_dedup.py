"""Embedding join, n-gram join, components, decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import decontaminate, embedding_join, ngram_join
from quarry.llm.components import connected_components
from quarry.llm.spans import ALNUM_WORDS, SPACE_WORDS, words_of

DOC = "doc_id long, text string, n int, comp int, rep int, hits int, frag int, a int"


def _texts(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 60))] for _ in range(n // 3)]
    out = []
    for b in base:
        out.append(" ".join(b))
        c = list(b)
        c[r.randrange(len(c))] = "zz"
        out.append(" ".join(c))
        out.append(" ".join(b[: max(1, len(b) * 9 // 10)]))
    return out + ["", None, "  \n ", "one two", "one  TWO", "x " * 3000, "x " * 3001, "Ünï çode wörds hère now ok", out[0], out[0]]


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_rules():
    texts = ["A-b  c\td e Ünd 12x".encode(), None, b"", "x y".encode()]
    assert np.diff(words_of(texts, SPACE_WORDS)[1]).tolist() == [5, 0, 0, 1]
    assert np.diff(words_of(texts, ALNUM_WORDS)[1]).tolist() == [6, 0, 0, 1]
    w, _ = words_of([b"Abc abc ABC abd", b"abc"], SPACE_WORDS)
    assert len({*w[:3].tolist(), int(w[4])}) == 1 and w[3] != w[0]


def test_ngram_components_equal_brute_force(spark):
    texts = _texts()
    rows = [(i * 3 + 1, t, 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(spark.createDataFrame(rows, DOC)).collect()}
    want = ngram_join.components_bruteforce([r[0] for r in rows], texts)
    assert {k: v["component_id"] for k, v in got.items()} == want
    assert [got[r[0]]["n_shingles"] for r in rows] == [len(s) for s in ngram_join.sets_bruteforce(texts)]


def test_ngram_repeated_rows_null_ids_and_empty_tables(spark):
    t = " ".join(f"k{i}" for i in range(40))
    half = " ".join([f"k{i}" for i in range(24)] + [f"m{i}" for i in range(16)])
    rows = [(1, t), (1, t), (1, t), (2, half), (2, half), (None, t), (7, t)]
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 36, 1)] * 3 + [(2, 36, 2)] * 2 + [(7, 36, 1), (None, 36, None)], key=str)
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_threshold_is_exact(spark):
    # 16 shingles against 12 of them: 75 %; 15 against 11 of them: under 75 %
    a, b = [f"p{i}" for i in range(20)], [f"q{i}" for i in range(19)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:16])), (3, " ".join(b)), (4, " ".join(b[:15]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_ngram_chain_and_hot_passage(spark):
    r = random.Random(9)
    words = [f"c{i}" for i in range(400)]
    hot = [f"h{i}" for i in range(60)]
    chain = [words[i * 6:i * 6 + 60] for i in range(30)]  # each links with its neighbours only
    shared = [[f"u{k}_{i}" for i in range(40)] + hot for k in range(60)]
    texts = [" ".join(x) for x in chain + shared]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == ngram_join.components_bruteforce(ids, texts)


def _vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 7.5])]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [float("inf")] + [1.0] * 23),
             (1005, [None] + [1.0] * 23), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e-30, 0.0]), (1009, [3e38, 0.0]), (1010, [5.0]), (None, [1.0, 2.0])]
    return rows + [(2000 + i, rows[0][1]) for i in range(20)]


@pytest.mark.parametrize("block_rows", [37, 4096])
def test_cosine_components_equal_brute_force(spark, block_rows):
    rows = _vectors()
    schema = "vec_id long, embedding array<float>, label int, n int, d int, rep int, side int"
    got = embedding_join.cosine_components(spark.createDataFrame([(a, b, 1, 2, 3, 4, 5) for a, b in rows], schema), block_rows=block_rows).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.float32(v))]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted(((i, links[i], find(i)) for i, _ in rows), key=str)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_cosine_empty_table(spark):
    assert embedding_join.cosine_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tiles_keep_every_pair_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 48))
    x[350:] = x[:350] + rng.normal(size=(350, 48)) * 0.33
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i < j}
    got = {(i, j) for a, b in embedding_join.tile_links(x, x, x @ q, x @ q, 0.9, True) for i, j in zip(a, b)}
    assert got == want and len(want) > 50


ITEMS = {1: " ".join(f"b{i}" for i in range(25)), 2: "Short item here", 10: "solo", 3: None, 4: " . ", 5: " ".join(f"b{i}" for i in range(12)), None: "null id words"}


def test_contamination_equals_brute_force(spark):
    r = random.Random(2)
    docs = []
    for k in range(60):
        w = [f"d{r.randrange(50)}" for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            n = r.randint(1, 25)
            s = r.randint(0, 25 - n)
            at = r.randint(0, len(w))
            w[at:at] = [f"B{i}" for i in range(s, s + n)]
        if k % 10 == 1:
            w += ["short", "ITEM", "here", "solo"]
        docs.append((k, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "!!"), (None, ITEMS[1]), (103, ITEMS[1] * 3), (104, "b0 " * 50000 + ITEMS[5]), (5, docs[5][1]), (105, "null id words")]
    rows = [(a, b, 1, 2, 3) for a, b in docs]
    got = decontaminate.contaminated_words(
        spark.createDataFrame(rows, "doc_id long, text string, id int, item_id int, hits int"),
        spark.createDataFrame([(i, t, 9) for i, t in ITEMS.items()], "item_id long, text string, doc_id int")).collect()
    want = []
    for i, t in docs:
        n, hit, ids = decontaminate.bruteforce(t, ITEMS)
        want.append((i, n, hit, sorted(x for x in ids if x != "None"), hit > 0))
    assert sorted(((g["doc_id"], g["n_words"], g["n_hit"], g["item_ids"], g["contaminated"]) for g in got), key=str) == sorted(want, key=str)


def test_contamination_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated_words(docs, bench).collect()] == [(1, 3, 0, 0, [], False)]
    assert decontaminate.contaminated_words(docs.limit(0), bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=10, max_size=10), st.lists(st.integers(0, 30), max_size=20), st.lists(st.integers(0, 30), max_size=20), st.lists(st.integers(0, 30), max_size=20))
def test_winnowing_guarantee(span, left, right, other):
    """Texts that share ten words share a fingerprint."""
    def prints(words):
        g = np.array([int.from_bytes(hashlib.blake2b(str(words[i:i + 5]).encode(), digest_size=8).digest(), "little") for i in range(len(words) - 4)], dtype=np.uint64)
        return set(g[decontaminate.winnow(g, 6)].tolist())
    assert prints(left + span + right) & prints(other + span)


def test_different_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (9, [0.0, 0.0, 1.0]), (9, [0.0, 0.0, 1.0]), (3, [0.0, 0.02, 1.0])]
    got = sorted(tuple(r) for r in embedding_join.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 2, 3, True), (5, 0, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 2, 3, False), (9, 2, 3, False)]


def test_contamination_of_rows_that_share_an_id(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, item), (None, "clean text"), (None, "x " + item), (4, "nothing here"), (4, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontaminate.contaminated_words(docs, bench).collect())
    assert {(a, b): c for a, b, c in got} == {("4", 2): 0, ("4", 12): 12, ("None", 2): 0, ("None", 12): 12, ("None", 13): 12}


def test_memory_of_a_long_text():
    """Words, shingles, fingerprints, votes and subwords of a text of 22 million bytes."""
    import tracemalloc

    import pandas as pd

    from quarry.llm import langid, quality
    r = random.Random(2)
    vocab = [f"word{i}" for i in range(5000)]
    text = " ".join(r.choices(vocab, k=2_500_000))
    raw = text.encode()
    table = np.ones((1 << langid.BUCKET_BITS, 3))
    pdf = pd.DataFrame({"id": [1], "text": [raw]})
    jobs = {"words": lambda: words_of([raw], SPACE_WORDS), "shingles": lambda: list(ngram_join.shingle_sets([raw], 5)), "votes": lambda: quality.votes([raw]),
            "shapes": lambda: quality.shape_scores([raw], np.ones(1 << quality.BUCKET_BITS)), "subwords": lambda: langid._mean_logits([text], table, langid.BUCKET_BITS),
            "fingerprints": lambda: list(decontaminate._fingerprints(5, 10, [])([pdf]))}
    for name, job in jobs.items():
        tracemalloc.start()
        job()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6, (name, peak)


def test_blocks_give_the_same(monkeypatch):
    from quarry.llm import langid, quality, spans
    texts = [t.encode() if t is not None else None for t in _texts(3)]
    words = [words_of([t], SPACE_WORDS)[0].tolist() for t in texts]
    measured = [quality.measures([t]) for t in texts]
    table = np.random.default_rng(1).standard_normal((1 << langid.BUCKET_BITS, 3))
    logits = [langid._mean_logits([t.decode() if t is not None else None], table, langid.BUCKET_BITS)[0] for t in texts]
    monkeypatch.setattr(spans, "CHUNK_BYTES", 40)
    monkeypatch.setattr(quality, "TEXT_BYTES", 50)
    assert [words_of([t], SPACE_WORDS)[0].tolist() for t in texts] == words
    h, at = words_of(texts, SPACE_WORDS)
    assert [h[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == words
    for t, m in zip(texts, measured):
        got = quality.measures([t])
        assert all(np.array_equal(got[k], m[k], equal_nan=True) for k in m)
    cut = [list(spans.text_blocks([t.decode() if t is not None else None], 60)) for t in texts]
    assert all("".join(x or "" for _, parts in c for x in parts) == (t or b"").decode() for c, t in zip(cut, texts))
    monkeypatch.setattr(langid, "text_blocks", lambda texts: spans.text_blocks(texts, 60))
    for t, z in zip(texts, logits):
        assert np.allclose(langid._mean_logits([t.decode() if t is not None else None], table, langid.BUCKET_BITS)[0], z)


"""Posting blocks and top-k by block bounds against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.inverted_index import ClassTree, posting_blocks, read_postings, top_k, write_index


def test_posting_blocks(spark, tmp_path):
    r = random.Random(2)
    sets = [(i, sorted({r.choice("abcdefgh") for _ in range(r.randint(0, 4))} | {"hot"})) for i in range(-40, 1000, 3)]
    df = spark.createDataFrame([*sets, (None, ["hot", "z"]), sets[0], (5000, [])], "id long, toks array<string>")
    write_index(df, str(tmp_path / "index"), bits=5)
    blocks = spark.read.parquet(str(tmp_path / "index"))
    want = sorted((t, i) for i, toks in sets for t in toks)
    assert sorted(tuple(x) for x in read_postings(blocks).collect()) == want
    for b in blocks.collect():
        ids = [i for t, i in want if t == b["tok"] and i // 32 == b["block"]]
        assert (b["first"], b["n"], len(b["gaps"])) == (ids[0], len(ids), len(ids) - 1) and b["n"] <= 32
        assert b["least"] == min(len(toks) for i, toks in sets if i in ids)
    assert blocks.where("tok = 'hot'").count() == len({i // 32 for i, _ in sets})  # a hot token lies in many blocks
    assert posting_blocks(df.where("false")).count() == 0


def _score(nq, ne, inter, boosted, pattern):
    return 0.6 * (inter / (nq + ne - inter) + 0.05 * boosted) + 0.4 * pattern


def _jac(a, b):
    return bin(a & b).count("1") / bin(a | b).count("1") if a | b else 0.0


@pytest.mark.parametrize("seed,bits,k", [(1, 2, 3), (3, 6, 1), (4, 3, 40)])
def test_top_k_equals_brute_force(spark, seed, bits, k):
    r = random.Random(seed)
    vocab = ["the", "of", "top"] + [f"w{i}" for i in range(25)]

    def some(n):
        return sorted({"the"} | {r.choice(vocab) for _ in range(r.randint(0, n))} if r.random() < 0.8 else {r.choice(vocab) for _ in range(r.randint(0, 2))})

    ex = [(r.randint(0, 10 ** 6) * 100 + i, some(4), r.choice([0, 1, 3, 6])) for i in range(90)]
    ex += [(10 ** 9 + i, ["of", "the"], 3) for i in range(30)]  # one class with a quarter of the rows
    qs = [(i, some(8), r.choice([0, 1, 2, 7])) for i in range(20)] + [(50, [], 3)]
    tree = ClassTree(spark.createDataFrame(ex, "eid long, toks array<string>, mask long").repartition(5), k, bits)
    got = {}
    for x in top_k(spark.createDataFrame(qs, "qid long, toks array<string>, mask long"), tree, F.col("tok") == "top", _score).collect():
        got.setdefault(x["qid"], []).append((x["rank"], x["eid"], round(x["score"], 9)))
    for qid, qt, qm in qs:
        scored = []
        for eid, et, em in ex:
            a, b = set(qt), set(et)
            s = _score(len(a), len(b), len(a & b), int("top" in a & b), _jac(qm, em)) if a and b else 0.0
            scored.append((-s, eid))
        want = [(i + 1, e, round(-s, 9)) for i, (s, e) in enumerate(sorted(scored)[:k])]
        assert sorted(got[qid]) == want, qid


def test_top_k_of_empty_tables(spark):
    none = spark.createDataFrame([], "eid long, toks array<string>, mask long")
    qs = spark.createDataFrame([(1, ["a"], 1)], "qid long, toks array<string>, mask long")
    score = _score
    assert top_k(qs, ClassTree(none, 3), F.col("tok") == "x", score).count() == 0
    some = spark.createDataFrame([(1, ["a"], 1), (None, ["a"], 1)], "eid long, toks array<string>, mask long")
    assert top_k(qs.where("false"), ClassTree(some, 3), F.col("tok") == "x", score).count() == 0
    assert [tuple(x) for x in top_k(qs, ClassTree(some, 3), F.col("tok") == "x", score).collect()] == [(1, 1, 1, 1.0)]

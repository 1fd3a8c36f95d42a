"""The rule cascade against plain Python, and its order."""

import random
import re
import tracemalloc

import numpy as np

from quarry.llm import rule_cascade as rc
from quarry.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def _plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    n, base = len(w), len(w) < 10 or 100 * len(hit) > 20 * len(w)
    row = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), base)
    if base:
        return (*row, False)

    def letter(c):
        return "a" <= c <= "z" or "A" <= c <= "Z" or ord(c) >= 128

    def mark(c):
        return 32 < ord(c) < 127 and not letter(c) and not "0" <= c <= "9"

    up, low = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    good = (row[2] / n <= 0.1 and 2 <= row[1] / n <= 16 and row[3] / max(1, len(lines)) <= 0.5 and up / max(1, up + low) <= 0.5
            and len(re.findall("[0-9]", text)) / row[1] <= 0.5 and sum(any(map(letter, x)) for x in w) / n >= 0.5
            and sum(any(mark(a) and mark(b) for a, b in zip(x, x[1:])) for x in w) / n <= 0.3
            and sum(a == b for a, b in zip(w, w[1:])) / n <= 0.3 and len(set(w)) / n ** 0.5 >= 1
            and sum(x.rstrip().endswith(("...", "…")) for x in lines) / max(1, len(lines)) <= 0.5
            and sum(x.lstrip().startswith(("* ", "- ", "• ")) for x in lines) / max(1, len(lines)) <= 0.95)
    return (*row, good)


def _texts(seed=5):
    r = random.Random(seed)
    vocab = [f"{r.choice('abcdeé')}{r.choice('xyzü')}{i}" for i in range(200)] + ["the", "of", "A", "-", "12", "…", "x#", "!!"]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) for _ in range(60)]
    out += ["\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 12))) for _ in range(60)]
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    clean = " ".join(words[:60])
    return out + [
        None, "", " \n\t", "one", "a b c d e f g h i j", clean, clean.upper(), clean + "\n" + clean, " ".join(w + "##" for w in words[:40]),
        " ".join(w + "?!" for w in words[:40]), " ".join(["same"] * 50), " ".join(str(i) * 3 for i in range(1000, 1040)),
        "\n".join(w + " and more..." + v for w, v in zip(words[:20], words[20:])), "\n".join(f"{w} {v}..." for w, v in zip(words[:20], words[20:])),
        "\n".join(f"- {w} {v}" for w, v in zip(words[:20], words[20:])), "\n".join(["line one here"] * 2 + words[:30]),
        "a b c\x1cd " + clean, "\r\n".join(words[:30]), " ".join(["x"] * 9 + words[:60]), clean, clean]


def test_cascade_equals_plain_python(spark, monkeypatch):
    texts = _texts()
    rows = [(i if i % 9 else None, t, i % 3, f"n{i}", i, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string, words int, key int").repartition(4)
    want = sorted(((i if i % 9 else -1), *_plain(t)) for i, t in enumerate(texts))

    def run(order=None):
        got = rc.apply_rules(docs) if order is None else docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInPandas(
            rc._judge(rc.RULES, order), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                        "base_failed boolean, kept boolean, failed_rule string, rules_measured long")
        return sorted((-1 if r["doc_id"] is None else r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
                      for r in got.collect())

    assert run() == want
    assert any(w[-1] for w in want) and any(not w[-1] and not w[-2] for w in want)
    for seed in range(3):  # the order of the rules changes no verdict
        order = random.Random(seed).sample(range(len(rc.RULES)), len(rc.RULES))
        assert run(order) == want
    assert rc.apply_rules(docs.where("false")).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_quality_rules"](spark, sf).collect()}
    want = {r["doc_id"]: _plain(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want


def test_blocks_of_long_texts(monkeypatch):
    texts = [(t or "").encode() for t in _texts(6)]
    long = b" ".join(texts)
    whole = [rc.base_counts(rc.Texts([t])) for t in (long, *texts)]
    rules = [[r.measure(rc.Texts([t])) for r in rc.RULES] for t in (long, *texts)]
    monkeypatch.setattr(rc, "BLOCK_BYTES", 64)
    for t, base, values in zip((long, *texts), whole, rules):
        got = rc.base_counts(rc.Texts([t]))
        assert all((got[k] == base[k]).all() for k in base)
        assert all(np.allclose(r.measure(rc.Texts([t])), v) for r, v in zip(rc.RULES, values))


def test_memory_of_a_long_text():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 2_000_000)).encode()
    tracemalloc.start()
    t = rc.Texts([text])
    base = rc.base_counts(t)
    failed, _ = rc.run_cascade(t, rc.RULES, list(range(len(rc.RULES))), ~base["base_failed"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base["n_words"][0] == 2_000_000 and peak < 25 * len(text)


def test_order_by_rejection_per_second():
    seconds = np.array([1.0, 4.0, 1.0, 0.5])
    sets = {0b0000: 50, 0b0001: 10, 0b0010: 30, 0b0101: 15}
    # rule 0 rejects 25 a second, rule 2 15, rule 1 7.5; after rule 0, rule 2 rejects nothing more
    assert rc.order_rules(seconds, sets) == [0, 1, 3, 2]
    assert rc.order_rules(seconds, {}) == [3, 0, 2, 1]


def test_short_circuit():
    seen = []

    def rule(name, bad):
        def measure(t):
            seen.append((name, len(t)))
            return np.array([float(r in bad) for r in t.rows])
        return rc.Rule(name, measure, high=0.5)

    rules = (rule("a", {b"x", b"y"}), rule("b", {b"y", b"z"}))
    failed, measured = rc.run_cascade(rc.Texts([b"x", b"y", b"z", b"ok", b"base"]), rules, [1, 0], np.array([True] * 4 + [False]))
    assert failed.tolist() == [0, 1, 1, -1, -1] and measured.tolist() == [2, 1, 1, 2, 0]
    assert seen == [("b", 4), ("a", 2)]

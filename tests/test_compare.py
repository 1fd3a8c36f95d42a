"""Result comparison: cell rules from the comparator's documented cases and
the tolerant matcher against a brute-force matcher."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.compare import (align_columns, eq_exact, eq_semantic, maximum_matching, multiset_compare,
                                      ordered_compare, tolerant_compare)


def _cell(spark, a, b, semantic=False, ta="string", tb="string"):
    df = spark.createDataFrame([(a, b)], f"a {ta}, b {tb}")
    fa, fb = ta == "double", tb == "double"
    e = eq_semantic(F.col("a"), F.col("b"), 1e-4, fa, fb) if semantic else eq_exact(F.col("a"), F.col("b"), fa, fb)
    return df.select(e.alias("r")).first()["r"]


def test_cells(spark):
    assert _cell(spark, None, None)
    assert _cell(spark, float("nan"), None, ta="double", tb="double")          # NULL and NaN unify
    assert _cell(spark, "007", 7.0, tb="double")                               # numeric text == number
    assert not _cell(spark, "Alice", "alice")
    assert _cell(spark, "Alice", " alice ", semantic=True)
    assert _cell(spark, 3.14159, 3.1416, semantic=True, ta="double", tb="double")
    assert not _cell(spark, 3.14159, 3.1416, ta="double", tb="double")
    assert _cell(spark, 0.082, 8.2, semantic=True, ta="double", tb="double")   # fraction vs percent
    assert not _cell(spark, 1.0, 2.0, semantic=True, ta="double", tb="double")
    assert not _cell(spark, "nan", "nan")                                      # NaN text never equal under exact


def test_multiset_cases(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    same_other_order = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b")], "k int, v string")
    dup_diff = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert multiset_compare(gold, same_other_order).first()["match"]
    r = multiset_compare(gold, dup_diff).first()
    assert not r["match"] and r["missing_rows"] == 1 and abs(r["partial_score"] - 2 / 3) < 1e-6
    empty = gold.limit(0)
    e = multiset_compare(empty, empty).first()
    assert e["match"] and e["partial_score"] == 1.0
    assert multiset_compare(gold, empty).first()["partial_score"] == 0.0


def test_ordered(spark):
    g = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "pos int, k int, v string")
    p = spark.createDataFrame([(1, 2, "b"), (2, 1, "a")], "pos int, k int, v string")
    r = ordered_compare(g, p).first()
    assert not r["ordered_match"] and r["position_hits"] == 0
    assert ordered_compare(g, g).first()["ordered_match"]


def test_align(spark):
    gold = spark.createDataFrame([(1, 2.0, "x")], "id int, total double, name string")
    pred = spark.createDataFrame([("x", 1, 2.0, 9)], "NAME string, id int, total_value double, extra int")
    g, a = align_columns(gold, pred)
    assert a.columns == g.columns == ["id", "total", "name"]
    assert a.first().asDict() == {"id": 1, "total": 2.0, "name": "x"}
    # gold columns without a partner leave both sides; nothing shared is None
    g, a = align_columns(gold, pred.select("id"))
    assert a.columns == g.columns == ["id"]
    assert align_columns(gold, pred.select(F.col("id").alias("qqq"))) is None


def test_ordered_null_first_cells(spark):
    g = spark.createDataFrame([(1, None, "x"), (2, "a", "y")], "pos int, c string, d string")
    p = spark.createDataFrame([(1, None, "z"), (2, "a", "y")], "pos int, c string, d string")
    r = ordered_compare(g, p).first()
    assert (r["gold_rows"], r["pred_rows"], r["position_hits"], r["ordered_match"]) == (2, 2, 1, False)


def _brute(gold, pred, rtol=1e-4):
    def eq(a, b):
        if a is None and b is None:
            return True
        if a is None or b is None:
            return False
        if isinstance(a, float) or isinstance(b, float):
            a, b = float(a), float(b)
            if abs(a - b) <= rtol * max(abs(a), abs(b), 1.0):
                return True
            return a != 0 and b != 0 and (abs(a / b - 100) <= 0.01 or abs(a / b - 0.01) <= 0.0001)
        return " ".join(str(a).lower().split()) == " ".join(str(b).lower().split())

    used, m = set(), 0
    for g in gold:
        for j, p in enumerate(pred):
            if j not in used and all(eq(x, y) for x, y in zip(g, p)):
                used.add(j)
                m += 1
                break
    return m


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tolerant_vs_brute_force(spark, seed):
    rnd = random.Random(seed)
    gold = [(rnd.choice(["a", "b", "c"]), round(rnd.uniform(-1000, 1000), 2)) for _ in range(60)]
    pred = []
    for s, x in gold:
        r = rnd.random()
        if r < 0.2:
            continue                                     # dropped
        if r < 0.4:
            pred.append((s.upper(), x * (1 + 1e-6)))      # tolerant partner
        elif r < 0.5:
            pred.append((s, x + 50.0))                    # wrong value
        else:
            pred.append((s, x))
    pred.append(("z", 1.0))
    schema = "s string, x double"
    r = tolerant_compare(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).first()
    assert r["matched_exact"] + r["matched_tolerant"] == _brute(gold, pred)
    assert r["gold_rows"] == len(gold) and r["pred_rows"] == len(pred)
    assert not math.isnan(r["partial_score"])


@pytest.mark.parametrize("seed", [11, 12])
def test_multiset_and_keyed_vs_python(spark, seed):
    from collections import Counter

    from quarry.operators.compare import keyed_mismatch_counts
    rnd = random.Random(seed)
    gold = [(rnd.randrange(30), rnd.choice(["x", "y", "Z"]), round(rnd.uniform(0, 100), 2)) for _ in range(80)]
    pred = [r for r in gold if rnd.random() > 0.15] + [(rnd.randrange(30), "x", 1.0) for _ in range(5)]
    schema = "k int, s string, v double"
    m = multiset_compare(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).first()
    cg, cp = Counter(gold), Counter(pred)
    assert m["matched_rows"] == sum((cg & cp).values())
    assert m["missing_rows"] == sum((cg - cp).values()) and m["extra_rows"] == sum((cp - cg).values())

    # keyed exact vs semantic mismatch counts against a direct Python count
    kg = {i: (f"s{i % 4}", float(i) * 1.5) for i in range(40)}
    kp = {}
    for i, (s, v) in kg.items():
        r = rnd.random()
        if r < 0.1:
            continue
        kp[i] = (s.upper() if r < 0.3 else s, v * (1 + 1e-6) if r < 0.5 else (v + 5 if r < 0.6 else v))
    g = spark.createDataFrame([(i, s, v) for i, (s, v) in kg.items()], "k int, s string, v double")
    p = spark.createDataFrame([(i, s, v) for i, (s, v) in kp.items()], "k int, s string, v double")
    ex = keyed_mismatch_counts(g, p, ["k"], semantic=False).first()
    se = keyed_mismatch_counts(g, p, ["k"], semantic=True).first()
    missing = sum(1 for i in kg if i not in kp)
    assert ex["s_mismatches"] == missing + sum(1 for i in kp if kp[i][0] != kg[i][0])
    assert ex["v_mismatches"] == missing + sum(1 for i in kp if kp[i][1] != kg[i][1])
    assert se["s_mismatches"] == missing
    assert se["v_mismatches"] == missing + sum(
        1 for i in kp if abs(kp[i][1] - kg[i][1]) > 1e-4 * max(abs(kp[i][1]), abs(kg[i][1]), 1.0)
        and not (kg[i][1] != 0 and abs(kp[i][1] / kg[i][1] - 100) <= 0.01))


def test_tolerant_match_finds_all_of_400(spark):
    """Two matchable rows per key on both sides, NULL against NaN, infinities, integers only."""
    gold = [(f"k{i}", 1000.0 + i * 7 + d) for i in range(200) for d in (0.0, 0.01)] + [("inf", float("inf")), ("nan", None)]
    pred = [(f"K{i}", (1000.0 + i * 7 + d) * 1.00003) for i in range(200) for d in (0.01, 0.0)] + [("INF", float("inf")), ("NaN ", float("nan"))]
    r = tolerant_compare(spark.createDataFrame(gold, "k string, v double"), spark.createDataFrame(pred, "k string, v double")).first()
    assert r["match"] and r["matched_exact"] + r["matched_tolerant"] == 402
    a, b = [(i * 1000, "x") for i in range(300)], [(i * 1000, "X") for i in range(1, 300)] + [(999_999_999, "x")]
    r = tolerant_compare(spark.createDataFrame(a, "n long, s string"), spark.createDataFrame(b, "n long, s string")).first()
    assert not r["match"] and r["unmatched_gold"] == 1 == r["unmatched_pred"]


def _kuhn(n_left, edges):
    """Size of a maximum matching of left nodes 0..n-1 with ``edges[i]``: augmenting paths one by one."""
    owner = {}

    def place(i, seen):
        for j in edges[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(n_left))


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_matching_is_maximum(spark, seed):
    """Random pairs between rows with copies, started from any valid matching."""
    r = random.Random(seed)
    gold = {f"g{i}": r.choice([1, 1, 2, 5]) for i in range(12)}
    pred = {f"p{i}": r.choice([1, 1, 2, 4]) for i in range(12)}
    if seed == 5:  # one row with many copies against many rows, both ways
        gold, pred = {"g0": 40, **{f"g{i}": 1 for i in range(1, 30)}}, {"p0": 25, **{f"p{i}": 1 for i in range(1, 40)}}
        pairs = [("g0", f"p{i}") for i in range(40)] + [(f"g{i}", "p0") for i in range(30)]
    else:
        pairs = [(g, p) for g in gold for p in pred if r.random() < (0.12 if seed % 2 else 0.2)]
    start, left, right = [], dict(gold), dict(pred)
    for g, p in r.sample(pairs, len(pairs) // 3):
        f = min(left[g], right[p])
        if f:
            start.append((g, p, f))
            left[g] -= f
            right[p] -= f
    edge = spark.createDataFrame([*pairs, ("none", "none")], "g string, p string")
    flow = maximum_matching(spark.createDataFrame([*gold.items()], "g string, n long"), spark.createDataFrame([*pred.items()], "p string, n long"),
                            spark.createDataFrame(start, "g string, p string, f long"), lambda golds: edge.join(golds, "g", "left_semi")).collect()
    copies = [(g, i) for g, n in gold.items() for i in range(n)]
    edges = [[(p, j) for p, n in pred.items() if (g, p) in set(pairs) for j in range(n)] for g, _ in copies]
    assert sum(x["f"] for x in flow) == _kuhn(len(copies), edges)
    assert {(x["g"], x["p"]) for x in flow} <= set(pairs) and all(x["f"] > 0 for x in flow)
    for side, have in (("g", gold), ("p", pred)):
        for key, n in have.items():
            assert sum(x["f"] for x in flow if x[side] == key) <= n


@pytest.mark.parametrize("seed", [1, 2])
def test_tolerant_match_is_maximum(spark, seed):
    """Values closer than the tolerance to several others, with copies: exact pairs have to give way."""
    r = random.Random(seed)
    gold = [("a", 1000.0 + 0.03 * r.randint(0, 40)) for _ in range(40)] + [("b", None)] * 3
    pred = [("A", 1000.0 + 0.03 * r.randint(0, 40)) for _ in range(38)] + [("B", float("nan"))] * 2
    df = [spark.createDataFrame(x, "s string, x double") for x in (gold, pred)]
    got = tolerant_compare(*df).first()
    near = [[j for j, (s, y) in enumerate(pred) if s.lower() == t and ((x is None and s == "B") or (x is not None and s == "A" and abs(x - y) <= 1e-4 * max(abs(x), abs(y), 1.0)))]
            for t, x in gold]
    assert got["matched_exact"] + got["matched_tolerant"] == _kuhn(len(gold), near)


def test_exact_pairs_give_way(spark):
    gold = spark.createDataFrame([("k", 1000.0), ("k", 1000.08)], "s string, x double")
    pred = spark.createDataFrame([("k", 1000.0), ("k", 999.92)], "s string, x double")
    r = tolerant_compare(gold, pred).first()
    assert r["match"] and (r["matched_exact"], r["matched_tolerant"]) == (0, 2)
    r = tolerant_compare(gold.where("false"), pred).first()
    assert (r["gold_rows"], r["unmatched_pred"], r["match"], r["superset_match"], r["partial_score"]) == (0, 2, False, True, 0.0)


def test_row_keys_are_sixteen_bytes(spark):
    """Keys are what matching shuffles and writes in every step: two 64-bit numbers, not their decimal text."""
    from quarry.operators.compare import with_row_key

    df = spark.range(500).selectExpr("id % 250 as a", "cast(id % 250 as string) as b", "if(id % 250 = 7, null, id % 250 / 4) as c")
    keys = [bytes(r["_rk"]) for r in with_row_key(df).select("_rk").collect()]
    assert all(len(k) == 16 for k in keys) and len(set(keys)) == 250

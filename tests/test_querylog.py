"""Query-log mining helpers and the similarity joins against brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quarry.operators.querylog import (near_duplicate_pairs, normalize_sql, table_refs, token_budget,
                                       top_k_similar)


def test_normalize_and_tables(spark):
    sql = ("WITH recent AS (SELECT * FROM db.orders o WHERE x = 'a b') -- note\n"
           "SELECT /* c */ r.id FROM recent r JOIN customer c ON r.k = c.k")
    df = spark.createDataFrame([(sql,)], "s string").select(normalize_sql("s").alias("n"))
    n = df.first()["n"]
    assert "note" not in n and "/*" not in n and "'a b'" not in n and "''" in n
    t = df.select(table_refs("n").alias("t")).first()["t"]
    assert t == ["customer", "orders"]


def test_token_budget(spark):
    r = spark.createDataFrame([("",), ("abc",), ("x" * 8,)], "t string").select(token_budget("t").alias("b"))
    assert [x["b"] for x in r.collect()] == [0, 1, 3]


def _tok(s):
    return set(re.findall(r"[a-z0-9_]+", s.lower()))


def test_near_duplicates_vs_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rnd.sample(words, 12)) for _ in range(15)]
    docs = []
    for i, b in enumerate(base):
        docs.append((i * 2, b))
        w = b.split()
        if i % 2:
            w[rnd.randrange(len(w))] = "zz"           # near copy
        docs.append((i * 2 + 1, " ".join(w)))
    got = {(r["lid"], r["rid"]) for r in near_duplicate_pairs(spark.createDataFrame(docs, "id long, text string"), None).collect()}
    want = set()
    for (a, ta), (b, tb) in itertools.combinations(docs, 2):
        sa, sb = _tok(ta), _tok(tb)
        if len(sa | sb) and len(sa & sb) / len(sa | sb) >= 0.8:
            want.add((min(a, b), max(a, b)))
    assert got == want


def test_top_k_similar_vs_brute_force(spark):
    from quarry.operators.querylog import SIMILARITY_KEYWORDS
    qs = [(1, "how many orders per month"), (2, "top 5 customers by total revenue"), (3, "zzz")]
    ex = [(10, "count orders by month", "SELECT count(*) FROM o GROUP BY m"),
          (11, "total revenue per customer", "SELECT sum(x) FROM o GROUP BY c ORDER BY 1 DESC LIMIT 5"),
          (12, "list orders", "SELECT * FROM o"),
          (13, "average price per month", "SELECT avg(p) FROM o GROUP BY m")]
    res = top_k_similar(spark.createDataFrame(qs, "qid long, text string"),
                        spark.createDataFrame(ex, "eid long, text string, sql string"), k=2).collect()
    got = {(r["qid"], r["rank"]): r["eid"] for r in res}
    # brute force with the same formula, computed in Spark for the pattern parts
    from quarry.operators.querylog import question_patterns, sql_skeleton
    qp = {r["qid"]: set(r["p"]) for r in spark.createDataFrame(qs, "qid long, text string")
          .select("qid", question_patterns("text").alias("p")).collect()}
    ep = {r["eid"]: set(r["p"]) for r in spark.createDataFrame(ex, "eid long, text string, sql string")
          .select("eid", sql_skeleton("sql").alias("p")).collect()}
    kw = set(SIMILARITY_KEYWORDS)
    for qid, qt in qs:
        scores = []
        for eid, et, _ in ex:
            a, b = _tok(qt), _tok(et)
            j = len(a & b) / len(a | b) if a | b else 0.0
            boost = min(len(a & b & kw) * 0.05, 0.15)
            u = qp[qid] | ep[eid]
            pj = len(qp[qid] & ep[eid]) / len(u) if u else 0.0
            scores.append((-(0.6 * (j + boost) + 0.4 * pj), eid))
        scores.sort()
        assert [got[(qid, 1)], got[(qid, 2)]] == [scores[0][1], scores[1][1]]


def test_column_refs(spark):
    from quarry.operators.querylog import column_refs
    sql = ("SELECT c.c_name, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
           "WHERE o.o_orderstatus = 'F' GROUP BY c.c_name ORDER BY total DESC")
    df = spark.createDataFrame([(sql,)], "s string").select(column_refs(normalize_sql("s")).alias("c"))
    cols = set(df.first()["c"])
    assert {"c_name", "o_totalprice", "o_custkey", "c_custkey", "o_orderstatus"} <= cols
    assert not cols & {"total", "sum", "orders", "customer", "o", "c"}


def test_column_references_skip_keywords(spark):
    from pyspark.sql import functions as F
    from quarry.operators.querylog import SQL_KEYWORDS, column_refs, normalize_sql
    cases = {
        "SELECT a1, b1 FROM t ORDER BY a1 DESC NULLS LAST": ["a1", "b1"],
        "WITH x AS (SELECT u1 AS v1 FROM t WHERE w1 > 3) SELECT v1, max(z1) FILTER (WHERE q1 = 'k') FROM x GROUP BY v1": ["q1", "u1", "w1", "z1"],
        "SELECT t.a1 FROM db.tab AS t JOIN other o ON t.k1 = o.k2": ["a1", "k1", "k2"],
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", column_refs(normalize_sql("s")).alias("c"))
    got = {r["s"]: r["c"] for r in df.collect()}
    assert {k: sorted(v) for k, v in got.items()} == cases
    assert {"nulls", "first", "last", "filter", "intersect", "except", "values", "set"} <= set(SQL_KEYWORDS)


def test_mining_expressions_name_their_input_once(spark):
    """The text under a label or reference expression is evaluated once a row, not once a rule."""
    from pyspark.sql import functions as F
    from quarry.operators.querylog import column_refs, question_patterns, sql_skeleton

    df = spark.createDataFrame([("SELECT aa FROM t WHERE bb > 1", "Total price per user")], "s string, q string")
    for build in (lambda c: table_refs(c), lambda c: column_refs(c), lambda c: sql_skeleton(c), lambda c: question_patterns(c)):
        plan = df.select(F.explode(build(normalize_sql(F.concat("s", "q")))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(s") == 1
    got = df.select(column_refs(normalize_sql("s")).alias("c"), sql_skeleton("s").alias("k"), question_patterns("q").alias("p")).first()
    assert got["c"] == ["aa", "bb"] and got["k"] == [] and got["p"] == ["AGG_SUM", "HAS_AGGREGATION", "HAS_GROUP_BY"]


def test_similar_pairs_signatures_lose_no_pair(spark):
    """The signature bound keeps every pair at the threshold; far sets are told apart without their tokens."""
    import random

    from quarry.operators.querylog import _signatures

    rng = random.Random(3)
    base = [[f"w{i}_{j}" for j in range(40)] for i in range(6)]
    docs = [(10 * i + c, " ".join(x if rng.random() > 0.06 * c else f"z{i}{c}{x}" for x in b)) for i, b in enumerate(base) for c in range(4)]
    sets = {i: set(t.split()) for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(docs, "id long, text string")
    assert want and {(r["lid"], r["rid"]) for r in near_duplicate_pairs(df, None).collect()} == want
    sig = {r["id"]: [r[f"s{w}"] & (1 << 64) - 1 for w in range(4)]
           for r in _signatures(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, toks array<string>")).collect()}
    for a in sets:
        for b in sets:
            apart = sum((x ^ y).bit_count() for x, y in zip(sig[a], sig[b], strict=True))
            assert apart <= len(sets[a] ^ sets[b])
    assert sum((x ^ y).bit_count() for x, y in zip(sig[0], sig[10], strict=True)) > 16


def test_leakage_audit_links_items_without_tokens(spark, tmp_path):
    """Items of equal text without any token are linked through their smallest id."""
    import __spark_entry__ as e

    spark.createDataFrame([(1, "\u4f60\u597d"), (2, "plain words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "\u4f60\u597d"), (7, " \u4f60\u597d"), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["kind"], r["lid"], r["rid"]) for r in e.queries()["L11_leakage_audit"](spark, str(tmp_path)).collect()}
    assert got == {("doc_bench_exact", 1, 5), ("bench_exact_member", 7, 5)}


def _near(docs, others=None):
    pairs = itertools.combinations(docs, 2) if others is None else itertools.product(docs, others)
    sets = {t: _tok(t) for _, t in [*docs, *(others or [])]}
    return {(a, b) for (a, x), (b, y) in pairs if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) > 0}


def test_leakage_audit_lists_every_pair(spark, tmp_path):
    """Copies are listed by all their pairs, not through a representative; repeated rows count as often as they come."""
    import __spark_entry__ as e

    words = [f"w{i}" for i in range(20)]
    a, b = " ".join(words), " ".join([*words[:19], "other"])
    docs = [(1, a), (2, a.upper()), (3, b), (4, b), (5, "far away"), (6, None), (4, b), (None, a)]
    items = [(7, f" {a}"), (8, a), (9, b), (10, "nothing here")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(str, ((r["kind"], r["lid"], r["rid"], r["jaccard"]) for r in e.queries()["L11_leakage_audit"](spark, str(tmp_path)).collect())))
    near = round(19 / 21, 6)
    dd = [(1, 2, 1.0), (1, 3, near), (2, 3, near), *[(1, 4, near), (2, 4, near), (3, 4, 1.0)] * 2]
    db = [(i, j, 1.0 if (t.lower() == a) == (j < 9) else near) for i, t in docs if t in (a, a.upper(), b) for j in (7, 8, 9)]
    ex = [(i, j, 1.0) for i, t in docs if t for j, x in items if x.strip() == t.lower()]
    want = [("doc_doc_near", *x) for x in dd] + [("doc_bench_near", *x) for x in db] + [("doc_bench_exact", *x) for x in ex]
    want += [("doc_member", 2, 1, 1.0), ("doc_member", 4, 3, 1.0), ("bench_member", 8, 7, 1.0), ("bench_exact_member", 8, 7, 1.0)]
    assert got == sorted(map(str, want))


def test_pairs_of_a_large_class_are_made_once(spark):
    """A class of more members than one list holds gives each of its pairs once, and those with a near class."""
    from quarry.operators.querylog import member_pairs

    members = spark.createDataFrame([(i, i, 0, 600) for i in range(600)] + [(600, 1000, 1, 1)], "row long, id long, class long, copies long")
    near = spark.createDataFrame([(0, 1, 0.9)], "lid long, rid long, jaccard double")
    pairs = [(r["lid"], r["rid"], r["jaccard"]) for r in member_pairs(near, members).collect()]
    assert len(pairs) == len(set(pairs)) == 600 * 599 // 2 + 600
    assert {p for p in pairs if p[2] == 0.9} == {(i, 1000, 0.9) for i in range(600)}
    assert {(r["lid"], r["rid"]) for r in member_pairs(near, members.where("class = 1"), members.where("class = 0")).collect()} == set()
    back = near.select(F.col("rid").alias("lid"), F.col("lid").alias("rid"), "jaccard")
    assert len(member_pairs(back, members.where("class = 1"), members.where("class = 0")).collect()) == 600


def test_similarity_join_in_small_batches(spark):
    """Tokens and blocks that go over many batches lose no pair, also of large sets, and a pair comes about once."""
    from quarry.operators import querylog as QL

    rng = random.Random(5)
    sizes = [6, 12, 40, 40, 470, 900]
    base = [[f"w{i % 3}_{j}" for j in range(n)] for i, n in enumerate(sizes)]
    docs = [(100 * i + c, " ".join(x if rng.random() > 0.02 * c else f"z{i}{c}{x}" for x in b)) for i, b in enumerate(base) for c in range(9)]
    items = [(7000 + i, t) for i, t in docs[::4]] + [(9000, "w0_1 w1_1")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r["lid"], r["rid"]) for r in near_duplicate_pairs(frame(docs), None).collect()} == _near(docs)
        assert {(r["lid"], r["rid"]) for r in near_duplicate_pairs(frame(docs), frame(items)).collect()} == _near(docs, items)
        _, sets = QL.token_classes(frame(docs))
        met = QL._candidates(QL.prefix_table(sets, QL.token_rarity(sets), 0.8), None, 0.8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(set(met)) <= len(met) < 3 * len(set(met)) < 6 * len(_near(docs))


def test_a_set_travels_once_to_a_pair_of_blocks(spark):
    """Pairs are verified without their sets as columns: no join puts a set on every pair."""
    from quarry.operators.querylog import later_near_copies

    docs = [(i, " ".join(f"w{j}" for j in range(60) if j != i)) for i in range(50)]
    df = spark.createDataFrame(docs, "id long, text string")
    near = near_duplicate_pairs(df, None)
    assert near.count() == 50 * 49 // 2
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("MapInArrow") == 1
    assert {r["id"] for r in later_near_copies(df).collect()} == set(range(1, 50))


def test_a_sketch_per_type_not_per_user(spark, tmp_path):
    """The sketch is aggregated apart from the distinct count: no group (type, user) holds one."""
    import __spark_entry__ as e

    rows = [(i, i % 5, None if i % 7 == 0 else "ab"[i % 2]) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    df = e.queries()["A5_approx_distinct"](spark, str(tmp_path))
    assert {(r["event_type"], r["exact_users"], r["approx_users"]) for r in df.collect()} == {("a", 5, 5), ("b", 5, 5), (None, 5, 5)}
    groups = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate" in x or "ObjectHash" in x]
    assert not any("approx_count_distinct" in x and "user_id" in x.split("functions=")[0] for x in groups)


def test_table_overlap_ranks_candidates_by_set(spark, tmp_path):
    """Candidates are ranked per distinct table set: the plan has no row per query and set."""
    import datetime

    import __spark_entry__ as e

    rows = [(i, i % 4, "O", 1000.0 * i, datetime.date(1995, 1, 1), "1-URGENT") for i in [*range(30), 2, 2]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    df = e.queries()["L10_top_k_table_overlap"](spark, str(tmp_path))
    got = {}
    for r in df.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["eid"], r["shared"])
    assert len(got) == 30 and all(sorted(x) == [1, 2, 3] for x in got.values())
    assert got[0] == {1: (1, 1), 2: (2, 1), 3: (2, 1)}
    assert got[2] == {1: (0, 1), 2: (0, 1), 3: (0, 1)}  # three rows of id 2
    assert got[1][1] == (7, 2)


def test_label_and_reference_patterns_are_cheap_and_unchanged(spark):
    """Words are looked for before a pattern, and no pattern reads a long word once per letter of it."""
    import time
    from quarry.operators.querylog import LABEL_BITS, SKELETON_RULES, _CALLED, _CTE, _QUALIFIED, column_refs, sql_skeleton
    texts = ["select count (a), COUNTif(b), discount(c), max\n(d) from t", "TOYEAR(x) over (partition by y) group  by z", "groupby by group", "within (select 1)",
             "WITH a AS (select 1), 1b as(select x) select a1.b2.c3, 9t.u9 from a join b.c d", "limit", "limits order\tby", "sumif( join) f1 (g2(3h(", "a.b.c. d", "", "uniqexactif(todate(x))"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    old = {_CTE: r"(?i)(\w+)\s+as\s*\(", _CALLED: r"([A-Za-z_]\w*)\s*\(", _QUALIFIED: r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)"}
    for r in df.select("s", sql_skeleton("s").alias("k"), *[F.regexp_extract_all("s", F.lit(rx), F.lit(0)).alias(f"x{i}") for i, rx in enumerate(old)]).collect():
        up = r["s"].upper()
        want = {x for rx, labels in SKELETON_RULES if re.search(rx, up) for x in labels}
        want |= {"HAS_SUBQUERY"} if re.search(r"\bWITH\b", up) or up.count("SELECT") > 1 else set()
        assert r["k"] == sorted(want) and want <= set(LABEL_BITS), r["s"]
        for i, rx in enumerate(old.values()):
            assert r[f"x{i}"] == [m.group(0) for m in re.finditer(rx, r["s"])], (r["s"], rx)
    assert str(sql_skeleton("s")).count("contains") >= len(SKELETON_RULES)
    began = time.time()
    long = spark.createDataFrame([("select " + "a" * 150_000 + " from t where x = 1",)], "s string").select(column_refs("s").alias("c")).first()
    assert [len(c) for c in long["c"]] == [150_000] and time.time() - began < 15

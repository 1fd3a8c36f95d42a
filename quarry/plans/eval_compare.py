"""E ops: result-set comparison, fingerprints, votes, re-scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.compare import (align_columns, eq_exact, keyed_mismatch_counts, multiset_compare,
                                      ordered_compare, result_fingerprint, tolerant_compare)
from quarry.operators.ranking import ranked
from quarry.operators.windows import top_n_per_group
from quarry.plans.eval_bindings import (RESULT_GOLD_SQL, RESULT_PRED_KEYED_SQL, RESULT_PRED_MULTISET_SQL,
                                        RUN_LOG_SQL, md5_int, md5_int_sql, result_gold, result_pred_keyed,
                                        result_pred_multiset, run_log, sql_eq_exact, sql_eq_semantic)
from quarry.plans.registry import register
from quarry.sources.tables import Tables


def _mismatch_sql(eq) -> str:
    both = "g.o_custkey IS NOT NULL AND p.o_custkey IS NOT NULL"
    cols = [("n_orders", False, False), ("total", True, True), ("top_status", False, False)]
    parts = [f"count(*) FILTER (WHERE NOT ({both} AND {eq(f'g.{c}', f'p.{c}', a_float=af, b_float=bf)})) AS {c}_mismatches"
             for c, af, bf in cols]
    return (f"WITH {RESULT_PRED_KEYED_SQL} SELECT count(*) AS n_keys, " + ", ".join(parts) +
            " FROM gold g FULL JOIN pred p ON g.o_custkey = p.o_custkey")


@register("E1_exact_cell_mismatches", _mismatch_sql(sql_eq_exact))
def e1(t: Tables):
    return keyed_mismatch_counts(result_gold(t), result_pred_keyed(t), ["o_custkey"], semantic=False)


@register("E2_semantic_cell_mismatches", _mismatch_sql(sql_eq_semantic))
def e2(t: Tables):
    return keyed_mismatch_counts(result_gold(t), result_pred_keyed(t), ["o_custkey"], semantic=True)


@register("E3_ordered_exact", f"""
WITH {RESULT_GOLD_SQL},
g AS (SELECT row_number() OVER (ORDER BY total DESC, o_custkey) AS pos, * FROM gold),
p AS (SELECT row_number() OVER (ORDER BY n_orders DESC, total DESC, o_custkey) AS pos, * FROM gold)
SELECT count(g.pos) AS gold_rows, count(p.pos) AS pred_rows,
       count(*) FILTER (WHERE g.pos IS NOT NULL AND p.pos IS NOT NULL AND g.o_custkey = p.o_custkey
                        AND g.n_orders = p.n_orders AND g.total = p.total AND g.top_status = p.top_status) AS position_hits,
       count(*) FILTER (WHERE g.pos IS NOT NULL AND p.pos IS NOT NULL AND g.o_custkey = p.o_custkey
                        AND g.n_orders = p.n_orders AND g.total = p.total AND g.top_status = p.top_status) = count(g.pos)
         AND count(g.pos) = count(p.pos) AS ordered_match,
       round(count(*) FILTER (WHERE g.pos IS NOT NULL AND p.pos IS NOT NULL AND g.o_custkey = p.o_custkey
                        AND g.n_orders = p.n_orders AND g.total = p.total AND g.top_status = p.top_status) / count(g.pos), 6) AS partial_score
FROM g FULL JOIN p ON g.pos = p.pos
""")
def e3(t: Tables):
    """Gold in 'ORDER BY total DESC' order vs a prediction sorted by count:
    positions come from the skew-safe global ranking, then a positional join."""
    g = result_gold(t)
    gp = ranked(g, [F.col("total").desc(), F.col("o_custkey")], row_number="pos")
    pp = ranked(g, [F.col("n_orders").desc(), F.col("total").desc(), F.col("o_custkey")], row_number="pos")
    return ordered_compare(gp, pp, "pos")


_MULTISET_ORACLE = f"""
WITH {RESULT_PRED_MULTISET_SQL},
gk AS (SELECT o_custkey, n_orders, total, top_status, count(*) AS c FROM gold GROUP BY ALL),
pk AS (SELECT o_custkey, n_orders, total, top_status, count(*) AS c FROM pred GROUP BY ALL),
j AS (SELECT coalesce(gk.c, 0) AS g, coalesce(pk.c, 0) AS p FROM gk FULL JOIN pk
      ON gk.o_custkey = pk.o_custkey AND gk.n_orders = pk.n_orders AND gk.total = pk.total AND gk.top_status = pk.top_status)
SELECT CAST(sum(g) AS BIGINT) AS gold_rows, CAST(sum(p) AS BIGINT) AS pred_rows, CAST(sum(least(g, p)) AS BIGINT) AS matched_rows,
       CAST(sum(greatest(g - p, 0)) AS BIGINT) AS missing_rows, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS extra_rows,
       sum(greatest(g - p, 0)) = 0 AND sum(greatest(p - g, 0)) = 0 AS match,
       round(sum(least(g, p)) / sum(g), 6) AS partial_score
FROM j"""


@register("E4_multiset_exact", _MULTISET_ORACLE)
def e4(t: Tables):
    return multiset_compare(result_gold(t), result_pred_multiset(t))


def _tolerant_sql(pred: str) -> str:
    """Gold rows with a semantically equal prediction.  ``o_custkey`` is unique
    on both sides and a match needs every cell equal, so matches are counted
    over all pairs that agree, each gold row once."""
    eq = " AND ".join(sql_eq_semantic(f"g.{c}", f"p.{c}", a_float=f, b_float=f) for c, f in (("n_orders", False), ("total", True), ("top_status", False)))
    return f"""pred AS ({pred}),
hit AS (SELECT count(*) AS n FROM gold g JOIN pred p ON g.o_custkey = p.o_custkey AND {eq}),
c AS (SELECT (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM pred) AS p, hit.n AS m FROM hit)"""


_E5_COLUMNS = """g AS gold_rows, p AS pred_rows, m AS matched_rows, g - m AS unmatched_gold, p - m AS unmatched_pred, g = m AND p = m AS match,
       g = m AS superset_match, round(CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE m / g END, 6) AS partial_score"""


def _tolerant(gold, pred):
    r = tolerant_compare(gold, pred)
    return r.select("gold_rows", "pred_rows", (F.col("matched_exact") + F.col("matched_tolerant")).alias("matched_rows"), "unmatched_gold",
                    "unmatched_pred", "match", "superset_match", "partial_score")


def _e5_sql(pred: str) -> str:
    gold = RESULT_GOLD_SQL.replace("gold AS (", "gold0 AS (", 1)
    return f"WITH {gold}, gold AS (SELECT CAST(o_custkey AS VARCHAR) || 'k' AS o_custkey, n_orders, total, top_status FROM gold0), {_tolerant_sql(pred)} SELECT {_E5_COLUMNS} FROM c"


def _text_key(g):
    return g.select(F.concat(F.col("o_custkey").cast("string"), F.lit("k")).alias("o_custkey"), "n_orders", "total", "top_status")


_CHANGED = """SELECT o_custkey, n_orders, CASE WHEN n_orders % 7 = 0 THEN total * 1.01 WHEN n_orders % 3 = 0 THEN total * 1.00002 ELSE total END AS total,
  CASE WHEN n_orders % 2 = 0 THEN lower(top_status) ELSE top_status END AS top_status FROM gold"""


def _changed(g):
    n = F.col("n_orders")
    return g.select("o_custkey", "n_orders", F.when(n % 7 == 0, F.col("total") * 1.01).when(n % 3 == 0, F.col("total") * 1.00002).otherwise(F.col("total")).alias("total"),
                    F.when(n % 2 == 0, F.lower("top_status")).otherwise(F.col("top_status")).alias("top_status"))


@register("E5_tolerant_match", _e5_sql(_CHANGED))
def e5(t: Tables):
    """Unordered tolerant match of gold vs a drifted, case-changed prediction
    with some rows beyond the tolerance (exact phase, then one-to-one
    matching of the rest).  The customer key is text, hence exact."""
    g = _text_key(result_gold(t))
    return _tolerant(g, _changed(g))


@register("E6_superset_match", _e5_sql("SELECT o_custkey, n_orders, total * 1.00002 AS total, lower(top_status) AS top_status FROM gold WHERE n_orders <> 9 "
                                       "UNION ALL SELECT o_custkey || 'x', n_orders, total, top_status FROM gold WHERE n_orders >= 20"))
def e6(t: Tables):
    """Superset tolerance under the tolerant cell rule: extra predicted rows
    are allowed, gold rows without a partner are not."""
    g = _text_key(result_gold(t))
    pred = g.where(F.col("n_orders") != 9).select("o_custkey", "n_orders", (F.col("total") * 1.00002).alias("total"), F.lower("top_status").alias("top_status"))
    return _tolerant(g, pred.unionByName(g.where(F.col("n_orders") >= 20).withColumn("o_custkey", F.concat("o_custkey", F.lit("x")))))


_SHIFTS = {"g": ("1", "1.00008"), "p": ("1", "0.99992")}
_NEAR = "abs({a} - {b}) <= 1e-4 * greatest(abs({a}), abs({b}), 1.0)"


def _e5_max_sql() -> str:
    """Two gold and two predicted rows a customer: the largest matching is two if either way of pairing them works."""
    def near(i, j):
        return "(" + _NEAR.format(a=f"total * {_SHIFTS['g'][i]}", b=f"total * {_SHIFTS['p'][j]}") + ")"
    both = f"({near(0, 0)} AND {near(1, 1)}) OR ({near(0, 1)} AND {near(1, 0)})"
    return f"""
WITH {RESULT_GOLD_SQL}, m AS (SELECT CASE WHEN {both} THEN 2 ELSE CASE WHEN {near(0, 0)} OR {near(0, 1)} OR {near(1, 0)} OR {near(1, 1)} THEN 1 ELSE 0 END END AS m FROM gold),
c AS (SELECT 2 * count(*) AS g, 2 * count(*) AS p, CAST(sum(m) AS BIGINT) AS m FROM m)
SELECT {_E5_COLUMNS} FROM c"""


@register("E5_maximum_match", _e5_max_sql())
def e5_maximum(t: Tables):
    """Tolerant match where exact pairs stand in the way: of two gold and two
    predicted values a customer, one is equal, but only the crossed pairing
    matches both, so taking equal rows first and keeping them finds half."""
    g = _text_key(result_gold(t)).select("o_custkey", "total")

    def both(side):
        return g.select("o_custkey", (F.col("total") * float(_SHIFTS[side][0])).alias("total")).unionByName(
            g.select("o_custkey", (F.col("total") * float(_SHIFTS[side][1])).alias("total")))
    return _tolerant(both("g"), both("p"))


@register("E7_partial_score", f"""
WITH {RESULT_GOLD_SQL}, pred AS (SELECT * FROM gold WHERE n_orders > 5),
gk AS (SELECT *, 1 AS one FROM gold), pk AS (SELECT *, 1 AS one FROM pred)
SELECT count(gk.one) AS gold_rows, count(pk.one) AS pred_rows, count(gk.one) FILTER (WHERE pk.one IS NOT NULL) AS matched_rows,
       round(CASE WHEN count(gk.one) = 0 THEN (CASE WHEN count(pk.one) = 0 THEN 1.0 ELSE 0.0 END)
             ELSE count(gk.one) FILTER (WHERE pk.one IS NOT NULL) / count(gk.one) END, 6) AS partial_score
FROM gk FULL JOIN pk ON gk.o_custkey = pk.o_custkey AND gk.n_orders = pk.n_orders AND gk.total = pk.total
  AND gk.top_status = pk.top_status
""")
def e7(t: Tables):
    g = result_gold(t)
    m = multiset_compare(g, g.where(F.col("n_orders") > 5))
    return m.select("gold_rows", "pred_rows", "matched_rows", "partial_score")


_E8_KEY = "o_custkey, n_orders, total, top_status"


def _e8_case(name: str, cols: str, pred: str) -> str:
    keys = cols.split(", ")
    on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return (f"SELECT '{name}' AS case_name, CAST(sum(coalesce(g.c, 0)) AS BIGINT) AS gold_rows, CAST(sum(coalesce(p.c, 0)) AS BIGINT) AS pred_rows, "
            f"CAST(sum(least(coalesce(g.c, 0), coalesce(p.c, 0))) AS BIGINT) AS matched_rows, "
            f"sum(abs(coalesce(g.c, 0) - coalesce(p.c, 0))) = 0 AS match "
            f"FROM (SELECT {cols}, count(*) AS c FROM gold GROUP BY ALL) g FULL JOIN (SELECT {cols}, count(*) AS c FROM ({pred}) GROUP BY ALL) p ON {on}")


@register("E8_column_alignment", f"""
WITH {RESULT_GOLD_SQL}
{_e8_case("renamed_and_more", _E8_KEY, "SELECT * FROM gold")}
UNION ALL {_e8_case("fewer", "o_custkey, total", "SELECT o_custkey, total FROM gold")}
UNION ALL {_e8_case("reordered_and_changed", _E8_KEY, "SELECT o_custkey, n_orders + CASE WHEN n_orders > 15 THEN 1 ELSE 0 END AS n_orders, total, top_status FROM gold")}
UNION ALL SELECT 'nothing_shared', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), count(*) = 0 FROM gold
""")
def e8(t: Tables):
    """Predictions with renamed, more, fewer, reordered or no shared columns:
    aligned by name (schema-only, driver side), then compared as multisets."""
    g = result_gold(t).select("o_custkey", "n_orders", "total", "top_status")
    more = g.select(F.col("total").alias("total_value"), F.col("top_status").alias("TOP_STATUS"), F.col("o_custkey").alias("custkey"),
                    F.lit("x").alias("extra_col"), F.col("n_orders").alias("n_orders_cnt"))
    fewer = g.select(F.col("total").alias("TOTAL"), "o_custkey")
    changed = g.select("top_status", "total", (F.col("n_orders") + F.when(F.col("n_orders") > 15, 1).otherwise(0)).alias("N_Orders"), "o_custkey")
    other = g.select(F.col("o_custkey").alias("zzz"))
    out = None
    for name, pred in (("renamed_and_more", more), ("fewer", fewer), ("reordered_and_changed", changed), ("nothing_shared", other)):
        both = align_columns(g, pred)
        if both is None:
            n = g.agg(F.count("*").alias("gold_rows")).crossJoin(pred.agg(F.count("*").alias("pred_rows")))
            one = n.select(F.lit(name).alias("case_name"), "gold_rows", "pred_rows", F.lit(0).cast("bigint").alias("matched_rows"),
                           ((F.col("gold_rows") == 0) & (F.col("pred_rows") == 0)).alias("match"))
        else:
            one = multiset_compare(*both).select(F.lit(name).alias("case_name"), "gold_rows", "pred_rows", "matched_rows", "match")
        out = one if out is None else out.unionByName(one)
    return out


@register("E9_scalar_shortcut", """
WITH v AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders)
SELECT 'same' AS case_name, CAST(n AS DOUBLE) AS gold_value, CAST(n AS DOUBLE) AS pred_value, n = n AS match FROM v
UNION ALL SELECT 'other', CAST(n AS DOUBLE), CAST(f AS DOUBLE), n = f FROM v
""")
def e9(t: Tables):
    """1x1 results compare by value only (column names and types ignored)."""
    gold = t.orders.agg(F.count("*").alias("n"))
    same = t.orders.agg((F.count("*") * 1.0).cast("string").alias("cnt"))
    other = t.orders.agg((F.count_if(F.col("o_orderstatus") == "F") * 1.0).cast("string").alias("cnt"))
    out = [gold.crossJoin(p).select(F.lit(name).alias("case_name"), F.col("n").cast("double").alias("gold_value"), F.col("cnt").cast("double").alias("pred_value"),
                                    eq_exact(F.col("n"), F.col("cnt")).alias("match")) for name, p in (("same", same), ("other", other))]
    return out[0].unionByName(out[1])


@register("E10_empty_and_shape_verdicts", f"""
WITH {RESULT_GOLD_SQL}, c AS (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS neg, count(*) AS n FROM orders),
r AS (SELECT count(*) AS n FROM gold)
SELECT 'both_empty' AS case_name, neg = 0 AS match, CAST(CASE WHEN neg = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM c
UNION ALL SELECT 'pred_empty', n = 0 AND neg = 0, CAST(CASE WHEN n = 0 AND neg = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) FROM c
UNION ALL SELECT 'gold_empty', n = 0 AND neg = 0, CAST(CASE WHEN n = 0 AND neg = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) FROM c
UNION ALL SELECT 'column_count_mismatch', n = 0, CAST(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) FROM r
""")
def e10(t: Tables):
    """Verdicts decided from counts and schemas before any row compare."""
    o = t.orders
    empty = o.where(F.col("o_totalprice") < 0)

    def case(name, gold, pred):
        n = gold.agg(F.count("*").alias("g")).crossJoin(pred.agg(F.count("*").alias("p")))
        none = (F.col("g") == 0) & (F.col("p") == 0)
        # with rows on both sides the column counts decide: they differ here
        return n.select(F.lit(name).alias("case_name"), none.alias("match"), F.when(none, 1.0).otherwise(0.0).alias("score"))

    gold = result_gold(t)
    pred = gold.drop("top_status")
    assert len(gold.columns) != len(pred.columns)
    return (case("both_empty", empty, empty).unionByName(case("pred_empty", o, empty)).unionByName(case("gold_empty", empty, o))
            .unionByName(case("column_count_mismatch", gold, pred)))


@register("E11_mismatch_samples", f"""
WITH {RESULT_PRED_MULTISET_SQL},
gk AS (SELECT o_custkey, n_orders, total, top_status, count(*) AS c FROM gold GROUP BY ALL),
pk AS (SELECT o_custkey, n_orders, total, top_status, count(*) AS c FROM pred GROUP BY ALL),
j AS (SELECT coalesce(gk.o_custkey, pk.o_custkey) AS k, coalesce(gk.c, 0) - coalesce(pk.c, 0) AS d FROM gk FULL JOIN pk
      ON gk.o_custkey = pk.o_custkey AND gk.n_orders = pk.n_orders AND gk.total = pk.total AND gk.top_status = pk.top_status),
r AS (SELECT CASE WHEN d > 0 THEN 'missing' ELSE 'extra' END AS side, k, row_number() OVER (PARTITION BY d > 0 ORDER BY k) AS rn
      FROM j WHERE d != 0)
SELECT side, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE rn <= 3) AS sample_keys,
       count(*) FILTER (WHERE rn > 3) AS remainder FROM r GROUP BY side
""")
def e11(t: Tables):
    """First three differing rows per side (by key) plus the remainder count:
    the first rows by a group limit, the counts by a plain aggregate."""
    cols = ["o_custkey", "n_orders", "total", "top_status"]
    g = result_gold(t).groupBy(*cols).agg(F.count("*").alias("_g"))
    p = result_pred_multiset(t).groupBy(*cols).agg(F.count("*").alias("_p"))
    j = g.join(p, cols, "full_outer").select(F.col("o_custkey").alias("k"),
                                             (F.coalesce("_g", F.lit(0)) - F.coalesce("_p", F.lit(0))).alias("d"))
    r = j.where(F.col("d") != 0).select("k", F.when(F.col("d") > 0, "missing").otherwise("extra").alias("side"))
    first = top_n_per_group(r, ["side"], [F.col("k")], 3).groupBy("side").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    counts = r.groupBy("side").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(first), "side").select(  # two sides of three keys
        "side", F.array_join(F.transform("ks", lambda x: x.cast("string")), ",").alias("sample_keys"), (F.col("n") - F.size("ks")).alias("remainder"))


@register("E12_large_equal_size", """
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL),
k AS (SELECT *, count(*) AS c FROM p GROUP BY ALL),
j AS (SELECT coalesce(g.c, 0) AS g, coalesce(k.c, 0) AS p FROM g FULL JOIN k USING (l_orderkey, l_linenumber, l_quantity, l_returnflag))
SELECT 'reordered' AS case_name, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM lineitem) AS gate_pass, TRUE AS match, count(*) AS gold_rows, count(*) AS matched_rows FROM lineitem
UNION ALL SELECT 'perturbed', sum(g) = sum(p), sum(abs(g - p)) = 0, CAST(sum(g) AS BIGINT), CAST(sum(least(g, p)) AS BIGINT) FROM j
""")
def e12(t: Tables):
    """Large results: row-count gate, then the hash multiset compare for any
    size (no 5,000-row switch, no truncation); against the same rows and
    against rows of which one order in fifty differs."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    same = li.repartition(F.xxhash64(*li.columns))  # other tasks, other order
    other = li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    out = [multiset_compare(li, p).select(F.lit(name).alias("case_name"), (F.col("gold_rows") == F.col("pred_rows")).alias("gate_pass"), "match", "gold_rows", "matched_rows")
           for name, p in (("reordered", same), ("perturbed", other))]
    return out[0].unionByName(out[1])


@register("E14_result_fingerprint", """
WITH h AS (SELECT l_orderkey, md5(concat_ws('|', CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), l_returnflag)) AS h
           FROM lineitem)
SELECT l_orderkey, count(*) AS n_rows, CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS BIGINT) AS fp_sum,
       bit_xor(('0x' || substr(h, 9, 15))::BIGINT) AS fp_xor
FROM h GROUP BY l_orderkey
""")
def e14(t: Tables):
    """Order-free fingerprint of every order's line set (one result per order)."""
    li = t.lineitem
    return result_fingerprint(li, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_quantity").cast("decimal(12,2)"),
                                                   F.col("l_returnflag")])


_CAND_SQL = f"""cand AS (
  SELECT l.doc_id AS query_id, i.idx AS cand_idx,
         {md5_int_sql("CAST(l.doc_id AS VARCHAR) || '-' || CAST(i.idx AS VARCHAR)")} % 7 != 0 AS executed,
         md5(CAST(l.doc_id AS VARCHAR) || ':' || CAST({md5_int_sql("CAST(l.doc_id AS VARCHAR) || '-' || CAST(i.idx AS VARCHAR)")} % 3 AS VARCHAR)) AS fp
  FROM labels l CROSS JOIN (SELECT unnest(range(5)) AS idx) i)"""


def candidates(t: Tables, k: int = 5):
    """k candidate answers per query: executed flag and result fingerprint
    drawn from md5 of (query, candidate)."""
    idx = t.spark.range(k).select(F.col("id").cast("bigint").alias("cand_idx"))
    d = t.labels.select(F.col("doc_id").alias("query_id")).crossJoin(F.broadcast(idx))  # k rows
    h = md5_int(F.concat_ws("-", F.col("query_id").cast("string"), F.col("cand_idx").cast("string")))
    return d.select("query_id", "cand_idx", (h % 7 != 0).alias("executed"),
                    F.md5(F.concat_ws(":", F.col("query_id").cast("string"), (h % 3).cast("string"))).alias("fp"))


@register("E15_majority_vote", f"""
WITH {_CAND_SQL},
ex AS (SELECT query_id, count(*) FILTER (WHERE executed) AS n_exec FROM cand GROUP BY 1),
v AS (SELECT query_id, fp, count(*) AS votes, min(cand_idx) AS first_idx FROM cand WHERE executed GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first_idx) AS rn,
             count(*) OVER (PARTITION BY query_id) AS n_distinct FROM v)
SELECT w.query_id, w.first_idx AS winner_idx, w.votes, round(w.votes / ex.n_exec, 6) AS confidence, w.n_distinct
FROM w JOIN ex ON w.query_id = ex.query_id WHERE rn = 1
""")
def e15(t: Tables):
    """Vote: group executed candidates by result fingerprint; most votes
    wins, ties to the lowest candidate index; confidence = votes / executed."""
    c = candidates(t).where("executed")
    v = c.groupBy("query_id", "fp").agg(F.count("*").alias("votes"), F.min("cand_idx").alias("first_idx"))
    per = v.groupBy("query_id").agg(
        F.max_by(F.struct("first_idx", "votes"), F.struct(F.col("votes"), -F.col("first_idx"))).alias("w"),
        F.sum("votes").alias("n_exec"), F.count("*").alias("n_distinct"))
    return per.select("query_id", F.col("w.first_idx").alias("winner_idx"), F.col("w.votes").alias("votes"),
                      F.round(F.col("w.votes") / F.col("n_exec"), 6).alias("confidence"), "n_distinct")


@register("E16_rescore_diff", f"""
WITH {RUN_LOG_SQL},
new AS (SELECT config, query_id, executed,
               CASE WHEN executed = 0 THEN NULL
                    WHEN {md5_int_sql("config || CAST(query_id AS VARCHAR)")} % 11 = 0 THEN NULL
                    WHEN {md5_int_sql("config || CAST(query_id AS VARCHAR)")} % 13 = 0 THEN 1 - correct
                    ELSE correct END AS new_correct,
               {md5_int_sql("config || CAST(query_id AS VARCHAR)")} % 11 = 0 AND executed = 1 AS errored
        FROM run_log),
j AS (SELECT o.config, o.correct AS old_c, CASE WHEN n.new_correct IS NULL THEN o.correct ELSE n.new_correct END AS new_c,
             o.executed = 0 AS skipped, n.errored
      FROM run_log o JOIN new n ON o.config = n.config AND o.query_id = n.query_id)
SELECT config, count(*) AS n, count(*) FILTER (WHERE old_c = 0 AND new_c = 1) AS flips_up,
       count(*) FILTER (WHERE old_c = 1 AND new_c = 0) AS flips_down, count(*) FILTER (WHERE skipped) AS skipped,
       count(*) FILTER (WHERE errored) AS errored, round(avg(old_c), 6) AS old_rate, round(avg(new_c), 6) AS new_rate,
       round(avg(new_c) - avg(old_c), 6) AS delta
FROM j GROUP BY config
""")
def e16(t: Tables):
    """Diff of two scorings of the same runs joined on (config, query_id):
    flips each way; unexecuted runs skipped and failed re-scores keep the
    old verdict."""
    old = run_log(t)
    h = md5_int(F.concat(F.col("config"), F.col("query_id").cast("string")))
    new = old.select("config", "query_id",
                     F.when(F.col("executed") == 0, F.lit(None))
                     .when(h % 11 == 0, F.lit(None)).when(h % 13 == 0, 1 - F.col("correct"))
                     .otherwise(F.col("correct")).alias("new_correct"),
                     ((h % 11 == 0) & (F.col("executed") == 1)).alias("errored"))
    j = old.select("config", "query_id", F.col("correct").alias("old_c"), (F.col("executed") == 0).alias("skipped")) \
        .join(new, ["config", "query_id"])
    j = j.withColumn("new_c", F.coalesce("new_correct", "old_c"))
    return j.groupBy("config").agg(
        F.count("*").alias("n"), F.count_if((F.col("old_c") == 0) & (F.col("new_c") == 1)).alias("flips_up"),
        F.count_if((F.col("old_c") == 1) & (F.col("new_c") == 0)).alias("flips_down"),
        F.count_if("skipped").alias("skipped"), F.count_if("errored").alias("errored"),
        F.round(F.avg("old_c"), 6).alias("old_rate"), F.round(F.avg("new_c"), 6).alias("new_rate"),
        F.round(F.avg("new_c") - F.avg("old_c"), 6).alias("delta"))

"""L ops: query-log and text mining over the derived query log and the
driver's text tables (documents, benchmark, conversations)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import querylog as QL
from quarry.operators.inverted_index import read_postings, write_index
from quarry.operators.joins import broadcast_if_small, spread
from quarry.operators.querylog import (column_refs, extract_sql, harmonic, mask_values, member_pairs, normalize_sql, prf1,
                                       prefix_table, similar_pairs, token_classes, token_rarity, question_class, question_patterns, sql_skeleton, table_refs,
                                       token_budget, tokens, top_k_similar, top_n_value)
from quarry.operators.relational import arr_str
from quarry.plans.querylog_bindings import QUERY_LOG_SQL, query_log
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import Tables

# ----------------------------------------------------------- SQL twins


def _q(s: str) -> str:
    return s.replace("'", "''")


def sql_norm(x: str) -> str:
    return ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x +
            ", '--[^\\n]*', ' ', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '''[^'']*''', '''''', 'g'), '\\s+', ' ', 'g'))")


_KW = "[" + ", ".join(f"'{k}'" for k in QL.SQL_KEYWORDS) + "]"


def sql_tables(norm: str) -> str:
    cte = f"list_transform(regexp_extract_all({norm}, '(?i)(\\w+)\\s+as\\s*\\(', 1), lambda x: lower(x))"
    names = (f"list_distinct(list_transform(regexp_extract_all({norm}, '(?i)(?:from|join)\\s+([a-z_][a-z0-9_.]*)', 1), "
             f"lambda x: lower(string_split(x, '.')[-1])))")
    return f"list_sort(list_filter({names}, lambda x: NOT list_contains(list_concat({cte}, {_KW}), x)))"


def sql_skeleton_expr(sql: str) -> str:
    s = f"upper({sql})"
    arms = [f"CASE WHEN regexp_matches({s}, '{_q(rx)}') THEN [{', '.join(repr(x) for x in labels)}] ELSE []::VARCHAR[] END"
            for rx, labels in QL.SKELETON_RULES]
    arms.append(f"CASE WHEN regexp_matches({s}, '\\bWITH\\b') OR len(string_split({s}, 'SELECT')) - 1 > 1 "
                f"THEN ['HAS_SUBQUERY'] ELSE []::VARCHAR[] END")
    return f"list_sort(list_distinct(flatten([{', '.join(arms)}])))"


def sql_question_patterns(text: str) -> str:
    q = f"lower({text})"

    def any_of(words):
        return "(" + " OR ".join(f"contains({q}, '{_q(w)}')" for w in words) + ")"

    arms = [f"CASE WHEN contains({q}, '{_q(k)}') THEN ['{lbl}', 'HAS_AGGREGATION'] ELSE []::VARCHAR[] END"
            for k, lbl in QL.QUESTION_AGG_WORDS]
    W = QL.QUESTION_FLAG_WORDS
    ntab = " + ".join(f"(CASE WHEN contains({q}, '{t}') THEN 1 ELSE 0 END)" for t in QL.QUESTION_TABLE_WORDS)
    topn = f"regexp_matches({q}, '\\b(top|first|last|bottom)\\s+\\d+')"
    flags = [(any_of(W["HAS_GROUP_BY"]), "HAS_GROUP_BY"), (any_of(W["HAS_WINDOW"]), "HAS_WINDOW"),
             (f"(({ntab}) >= 2 OR {any_of(W['HAS_JOIN'])})", "HAS_JOIN"), (any_of(W["HAS_TIME"]), "HAS_TIME"),
             (topn, "HAS_LIMIT"), (f"({topn} OR {any_of(W['HAS_ORDER'])})", "HAS_ORDER"),
             (any_of(W["HAS_CONDITIONAL_AGG"]), "HAS_CONDITIONAL_AGG"), (any_of(W["HAS_SUBQUERY"]), "HAS_SUBQUERY")]
    arms += [f"CASE WHEN {c} THEN ['{lbl}'] ELSE []::VARCHAR[] END" for c, lbl in flags]
    return f"list_sort(list_distinct(flatten([{', '.join(arms)}])))"


def sql_tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '([a-z0-9_]+)', 1))"


# ----------------------------------------------------------- L ops


@register("L1_duplicate_queries", f"""
WITH {QUERY_LOG_SQL}
SELECT {sql_norm('gold_sql')} AS norm_sql, count(*) AS n_queries FROM query_log GROUP BY 1
""")
def l1(t: Tables):
    return query_log(t).groupBy(normalize_sql("gold_sql").alias("norm_sql")).agg(F.count("*").alias("n_queries"))


@register("L2_table_references", f"""
WITH {QUERY_LOG_SQL}
SELECT query_id, unnest({sql_tables(sql_norm('gold_sql'))}) AS table_name FROM query_log
""")
def l2(t: Tables):
    return query_log(t).select("query_id", F.explode(table_refs(normalize_sql("gold_sql"))).alias("table_name"))


# literal expectation: the columns of each query template
TEMPLATE_COLUMNS = {
    0: ["o_orderpriority", "o_orderstatus"], 1: ["c_custkey", "c_name", "o_custkey", "o_totalprice"],
    2: ["o_custkey", "o_orderdate", "o_totalprice"], 3: ["o_custkey", "o_orderkey", "o_totalprice"],
    4: ["l_discount", "l_returnflag"], 5: ["o_orderdate", "o_orderstatus", "o_totalprice"],
}
_COLUMNS_SQL = "tcols(tid, cols) AS (VALUES " + ", ".join(f"({k}, {v})" for k, v in TEMPLATE_COLUMNS.items()) + ")"


@register("L3_column_references", f"""
WITH {QUERY_LOG_SQL}, {_COLUMNS_SQL}
SELECT query_id, unnest(cols) AS column_name FROM query_log JOIN tcols ON tid = template_id
""")
def l3(t: Tables):
    """(query_id, column_name) references."""
    return query_log(t).select("query_id", F.explode(column_refs(normalize_sql("gold_sql"))).alias("column_name"))


def _f1_sql(name: str, p: str, g: str) -> str:
    tp = f"CAST(len(list_intersect({p}, {g})) AS DOUBLE)"
    empty = f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0 ELSE"
    return f"{empty} {tp} / len({p}) END AS {name}_pr, {empty} {tp} / len({g}) END AS {name}_rc"


_LINK_SQL = f"""ls AS (SELECT query_id, {sql_tables(sql_norm('pred_sql'))} AS p, {sql_tables(sql_norm('gold_sql'))} AS g, pc.cols AS pc, gc.cols AS gc
      FROM query_log JOIN qlb ON o_orderkey = query_id JOIN tcols pc ON pc.tid = _pid JOIN tcols gc ON gc.tid = template_id),
lr AS (SELECT *, {_f1_sql('t', 'p', 'g')}, {_f1_sql('c', 'pc', 'gc')} FROM ls),
lf AS (SELECT *, round(CASE WHEN t_pr + t_rc = 0 THEN 0.0 ELSE 2 * t_pr * t_rc / (t_pr + t_rc) END, 6) AS tf,
             round(CASE WHEN c_pr + c_rc = 0 THEN 0.0 ELSE 2 * c_pr * c_rc / (c_pr + c_rc) END, 6) AS cf FROM lr)"""

# overall link F1 of each logged query, for the metrics (after query_log)
LINK_F1_SQL = f"""{_COLUMNS_SQL}, {_LINK_SQL},
link AS (SELECT query_id, round(CASE WHEN tf + cf = 0 THEN 0.0 ELSE 2 * tf * cf / (tf + cf) END, 5) AS overall_f1 FROM lf)"""


@register("L4_link_f1", f"""
WITH {QUERY_LOG_SQL}, {_COLUMNS_SQL}, {_LINK_SQL}
SELECT query_id, round(t_pr, 6) AS table_precision, round(t_rc, 6) AS table_recall, tf AS table_f1,
       round(c_pr, 6) AS column_precision, round(c_rc, 6) AS column_recall, cf AS column_f1,
       round(CASE WHEN tf + cf = 0 THEN 0.0 ELSE 2 * tf * cf / (tf + cf) END, 5) AS overall_f1,
       array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(g, x))), ',') AS extra_tables,
       array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(p, x))), ',') AS missing_tables,
       array_to_string(list_sort(list_filter(pc, lambda x: NOT list_contains(gc, x))), ',') AS extra_columns,
       array_to_string(list_sort(list_filter(gc, lambda x: NOT list_contains(pc, x))), ',') AS missing_columns
FROM lf
""")
def l4(t: Tables):
    """Table and column precision / recall / F1 of predicted against gold SQL,
    and the harmonic mean of the two F1."""
    q = query_log(t).select("query_id", normalize_sql("pred_sql").alias("ps"), normalize_sql("gold_sql").alias("gs"))
    q = q.select("query_id", table_refs("ps").alias("p"), table_refs("gs").alias("g"), column_refs("ps").alias("pc"), column_refs("gs").alias("gc"))
    q = q.select("*", prf1(F.col("p"), F.col("g")).alias("t"), prf1(F.col("pc"), F.col("gc")).alias("c"))
    return q.select("query_id", F.col("t.precision").alias("table_precision"), F.col("t.recall").alias("table_recall"), F.col("t.f1").alias("table_f1"),
                    F.col("c.precision").alias("column_precision"), F.col("c.recall").alias("column_recall"), F.col("c.f1").alias("column_f1"),
                    F.round(harmonic(F.col("t.f1"), F.col("c.f1")), 5).alias("overall_f1"),
                    arr_str(F.array_except("p", "g")).alias("extra_tables"), arr_str(F.array_except("g", "p")).alias("missing_tables"),
                    arr_str(F.array_except("pc", "gc")).alias("extra_columns"), arr_str(F.array_except("gc", "pc")).alias("missing_columns"))


@register("L5_reference_popularity", f"""
WITH {QUERY_LOG_SQL}, {_COLUMNS_SQL},
r AS (SELECT 'table' AS kind, query_id, unnest({sql_tables(sql_norm('gold_sql'))}) AS name FROM query_log
      UNION ALL SELECT 'column', query_id, unnest(cols) FROM query_log JOIN tcols ON tid = template_id
      UNION ALL SELECT 'feature', query_id, unnest({sql_skeleton_expr('gold_sql')}) FROM query_log)
SELECT kind, name, count(DISTINCT query_id) AS n_queries FROM r GROUP BY 1, 2
""")
def l5(t: Tables):
    """How many logged queries use each table, column and structural feature
    (each name is distinct within a query, so a count suffices)."""
    q = query_log(t).select(normalize_sql("gold_sql").alias("s"), "gold_sql")

    def named(kind, names):
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    refs = F.concat(named("table", table_refs("s")), named("column", column_refs("s")), named("feature", sql_skeleton("gold_sql")))
    return q.select(F.explode(refs).alias("r")).groupBy(F.col("r.kind").alias("kind"), F.col("r.name").alias("name")).agg(F.count("*").alias("n_queries"))


@register("L6_sql_pattern_frequency", f"""
WITH {QUERY_LOG_SQL}, x AS (SELECT unnest({sql_skeleton_expr('gold_sql')}) AS pattern FROM query_log)
SELECT pattern, count(*) AS n_queries FROM x GROUP BY 1
""")
def l6(t: Tables):
    return query_log(t).select(F.explode(sql_skeleton("gold_sql")).alias("pattern")).groupBy("pattern") \
        .agg(F.count("*").alias("n_queries"))


@register("L7_question_pattern_frequency", f"""
WITH {QUERY_LOG_SQL}, x AS (SELECT unnest({sql_question_patterns('question')}) AS pattern FROM query_log)
SELECT pattern, count(*) AS n_questions FROM x GROUP BY 1
""")
def l7(t: Tables):
    return query_log(t).select(F.explode(question_patterns("question")).alias("pattern")).groupBy("pattern") \
        .agg(F.count("*").alias("n_questions"))


@register("L8_document_frequency", f"""
SELECT tok AS token, count(*) AS df FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY 1
""")
def l8(t: Tables):
    """Inverted index document frequency over whole documents."""
    return spread(t.documents.select("text")).select(F.explode(tokens("text")).alias("token")).groupBy("token") \
        .agg(F.count("*").alias("df"))


@register("L8_inverted_index", f"""
SELECT tok AS token, count(*) AS df, CAST(sum(id) AS BIGINT) AS id_sum, min(id) AS first_id, max(id) AS last_id, count(DISTINCT id // 128) AS n_blocks
FROM (SELECT DISTINCT doc_id AS id, unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY 1
""")
def l8_index(t: Tables):
    """Inverted index over whole documents, written in posting blocks of 128
    ids and read back: per token its ids and blocks."""
    path = scratch_path(t.spark, "inverted-index")
    write_index(spread(t.documents.select("doc_id", "text")).select(F.col("doc_id").alias("id"), tokens("text").alias("toks")), path)
    blocks = t.spark.read.parquet(path)
    ids = read_postings(blocks).groupBy("tok").agg(F.count("*").alias("df"), F.sum("id").alias("id_sum"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return (ids.join(blocks.groupBy("tok").agg(F.count("*").alias("n_blocks")), "tok")
            .select(F.col("tok").alias("token"), "df", "id_sum", "first_id", "last_id", "n_blocks"))


_KWL = "[" + ", ".join(f"'{k}'" for k in QL.SIMILARITY_KEYWORDS) + "]"


@register("L9_top_k_similar", f"""
WITH {QUERY_LOG_SQL},
q AS (SELECT item_id AS qid, {sql_tokens('text')} AS qt, {sql_question_patterns('text')} AS qp FROM benchmark),
e AS (SELECT query_id AS eid, {sql_tokens('question')} AS et, {sql_skeleton_expr('gold_sql')} AS ep FROM query_log),
s AS (SELECT qid, eid, len(list_intersect(qt, et)) AS inter, len(list_intersect(list_intersect(qt, et), {_KWL})) AS kwh,
             len(qt) AS nq, len(et) AS ne, len(list_intersect(qp, ep)) AS pi, len(list_distinct(list_concat(qp, ep))) AS pu
      FROM q, e),
sc AS (SELECT qid, eid, CASE WHEN nq = 0 OR ne = 0 THEN 0.0 ELSE 1.0 END * 0.6 * (CASE WHEN nq + ne - inter = 0 THEN 0.0 ELSE inter / (nq + ne - inter) END + least(kwh * 0.05, 0.15))
                      + CASE WHEN nq = 0 OR ne = 0 THEN 0.0 ELSE 0.4 END * (CASE WHEN pu = 0 THEN 0.0 ELSE pi / pu END) AS score FROM s)
SELECT qid, rank, eid, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, eid) AS rank FROM sc) WHERE rank <= 3
""")
def l9(t: Tables):
    """Top-3 logged examples for each benchmark question (dynamic example
    selection), exact, via inverted index + signature completion."""
    ql = query_log(t)
    return top_k_similar(t.benchmark.select(F.col("item_id").alias("qid"), "text"),
                         ql.select(F.col("query_id").alias("eid"), F.col("question").alias("text"),
                                   F.col("gold_sql").alias("sql")), k=3)


@register("L10_top_k_table_overlap", f"""
WITH {QUERY_LOG_SQL},
t AS (SELECT query_id, array_to_string({sql_tables(sql_norm('gold_sql'))}, ',') AS sig, {sql_tables(sql_norm('gold_sql'))} AS tabs FROM query_log),
sigs AS (SELECT DISTINCT sig, tabs FROM t),
ranked AS (SELECT query_id, sig, row_number() OVER (PARTITION BY sig ORDER BY query_id) AS srank FROM t),
cand AS (SELECT a.query_id AS qid, r.query_id AS eid, len(list_intersect(a.tabs, s.tabs)) AS shared
         FROM t a JOIN sigs s ON TRUE JOIN ranked r ON r.sig = s.sig AND r.srank <= 4 AND r.query_id != a.query_id)
SELECT qid, rank, eid, shared FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, eid) AS rank FROM cand)
WHERE rank <= 3
""")
def l10(t: Tables, k: int = 3):
    """Top-k other logged queries sharing the most tables.  The score only
    depends on the two table sets, so the candidates, the first k+1 ids of
    each set, are ranked once per distinct set; a query takes the first k
    that are not itself: exact, and linear in the log instead of quadratic.

    A repeated id may be up to k+1 times among a set's candidates: k rows an
    id and 2k in all hold the first k of any query."""
    path = scratch_path(t.spark, "table-sets")
    query_log(t).select("query_id", table_refs(normalize_sql("gold_sql")).alias("tabs")).withColumn("sig", F.array_join("tabs", ",")) \
        .where("query_id is not null and sig is not null").write.parquet(path)
    q = t.spark.read.parquet(path)
    sigs = q.select("sig", "tabs").distinct()
    first = (q.withColumn("srank", F.row_number().over(Window.partitionBy("sig").orderBy("query_id")))
             .where(F.col("srank") <= k + 1).select(F.col("sig").alias("esig"), F.col("query_id").alias("eid")))
    pairs = sigs.crossJoin(broadcast_if_small(sigs.select(F.col("sig").alias("esig"), F.col("tabs").alias("etabs")))) \
        .select("sig", "esig", F.size(F.array_intersect("tabs", "etabs")).alias("shared"))
    order = [F.col("shared").desc(), F.col("eid")]
    ranked = (pairs.join(first, "esig").withColumn("_own", F.row_number().over(Window.partitionBy("sig", "eid").orderBy(F.col("shared").desc())))
              .where(F.col("_own") <= k).withColumn("_rn", F.row_number().over(Window.partitionBy("sig").orderBy(*order))).where(F.col("_rn") <= 2 * k))
    best = ranked.groupBy("sig").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "eid", "shared"))), lambda x: F.struct(x["eid"].alias("eid"), x["shared"].alias("shared"))).alias("best"))
    found = (q.select(F.col("query_id").alias("qid"), "sig").repartition("qid").join(broadcast_if_small(best), "sig")
             .select("qid", F.explode(F.slice(F.filter("best", lambda x: x["eid"] != F.col("qid")), 1, k)).alias("x")).select("qid", "x.eid", "x.shared"))
    w = Window.partitionBy("qid").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "eid", "shared")


def _classes_sql(name: str, table: str, key: str) -> str:
    """Classes of equal token sets of a table: members and representatives."""
    return f"""
{name}t AS (SELECT DISTINCT {key} AS id, list_sort({sql_tokens('text')}) AS tk FROM {table} WHERE {key} IS NOT NULL),
{name}m AS (SELECT id, tk, min(id) OVER (PARTITION BY tk) AS rep FROM {name}t WHERE len(tk) > 0),
{name}r AS (SELECT id, tk FROM {name}m WHERE id = rep)"""


@register("L11_leakage_audit", f"""
WITH {_classes_sql('d', 'documents', 'doc_id')}, {_classes_sql('b', 'benchmark', 'item_id')},
da AS (SELECT doc_id AS id, {sql_tokens('text')} AS tk FROM documents),
ba AS (SELECT item_id AS id, {sql_tokens('text')} AS tk FROM benchmark),
dd AS (SELECT a.id AS lid, b.id AS rid, len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) AS j
       FROM da a JOIN da b ON a.id < b.id
       WHERE len(a.tk) > 0 AND len(b.tk) >= 0.8 * len(a.tk) AND len(a.tk) >= 0.8 * len(b.tk)),
db AS (SELECT a.id AS lid, b.id AS rid, len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) AS j
       FROM da a JOIN ba b ON len(b.tk) >= 0.8 * len(a.tk) AND len(a.tk) >= 0.8 * len(b.tk) WHERE len(a.tk) > 0),
ex AS (SELECT d.doc_id AS lid, b.item_id AS rid FROM documents d JOIN benchmark b
       ON regexp_replace(lower(trim(d.text)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(b.text)), '\\s+', ' ', 'g')),
bx AS (SELECT item_id AS id, min(item_id) OVER (PARTITION BY regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS rep
       FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)
SELECT 'doc_member' AS kind, id AS lid, rep AS rid, 1.0 AS jaccard FROM dm WHERE id <> rep
UNION ALL SELECT 'bench_member', id, rep, 1.0 FROM bm WHERE id <> rep
UNION ALL SELECT 'doc_doc_near', lid, rid, round(j, 6) FROM dd WHERE j >= 0.8
UNION ALL SELECT 'doc_bench_near', lid, rid, round(j, 6) FROM db WHERE j >= 0.8
UNION ALL SELECT 'doc_bench_exact', lid, rid, 1.0 FROM ex
UNION ALL SELECT DISTINCT 'bench_exact_member', id, rep, 1.0 FROM bx WHERE id <> rep
""")
def l11(t: Tables):
    """Leakage audit: exact text matches documents x benchmark, and
    near-duplicates (token Jaccard >= 0.8) within documents and between
    documents and benchmark, every pair of them.

    Texts with equal token sets are one class: an exact prefix-filtered
    similarity join finds the near classes, and the pairs of their members are
    made from them last (``*_near``).  ``*_member`` rows also give the
    representative (smallest id) of every other member of a class,
    ``bench_exact_member`` that of the items with the same normalised text.
    """
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    b = t.benchmark.select(F.col("item_id").alias("id"), "text")
    (dm, dr), (bm, br) = token_classes(d), token_classes(b)
    # one rarity order for both joins, so the documents' prefixes are built once
    rarity = token_rarity(dr, br)
    dpre, bpre = prefix_table(dr, rarity, 0.8), prefix_table(br, rarity, 0.8)
    dd = member_pairs(similar_pairs(dr, dpre, None, None, 0.8), dm).select(F.lit("doc_doc_near").alias("kind"), "lid", "rid", "jaccard")
    db = member_pairs(similar_pairs(dr, dpre, br, bpre, 0.8), dm, bm).select(F.lit("doc_bench_near").alias("kind"), "lid", "rid", "jaccard")
    norm = lambda c: F.sha2(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), 256)
    hashed = b.where("text is not null").select("id", norm(F.col("text")).alias("h"))
    named = hashed.where("id is not null")
    same_item = named.join(named.groupBy("h").agg(F.min("id").alias("rep")), "h").select("id", "rep")
    ex = (d.select(F.col("id").alias("lid"), norm(F.col("text")).alias("h")).join(hashed.withColumnRenamed("id", "rid"), "h")
          .select(F.lit("doc_bench_exact").alias("kind"), "lid", "rid", F.lit(1.0).alias("jaccard")))

    def same_set(m):
        m = m.where("copies > 1 and id is not null").select("class", "id").distinct()
        return m.join(m.groupBy("class").agg(F.min("id").alias("rep")), "class")

    def member(m, kind):
        return m.where("id <> rep").select(F.lit(kind).alias("kind"), F.col("id").alias("lid"), F.col("rep").alias("rid"), F.lit(1.0).alias("jaccard"))
    return dd.unionByName(db).unionByName(ex).unionByName(member(same_set(dm), "doc_member")).unionByName(member(same_set(bm), "bench_member")) \
        .unionByName(member(same_item.distinct(), "bench_exact_member"))


@register("L12_query_templates", f"""
WITH {QUERY_LOG_SQL}
SELECT regexp_replace(regexp_replace(regexp_replace(gold_sql, '''[^'']*''', '''VALUE''', 'g'),
         '(<=|>=|<>|!=|=|<|>)\\s*(\\d+(\\.\\d+)?)', '\\1 NUMBER', 'g'), '(?i)\\blimit\\s+\\d+', 'LIMIT N', 'g') AS template,
       count(*) AS n_queries
FROM query_log GROUP BY 1
""")
def l12(t: Tables):
    return query_log(t).groupBy(mask_values("gold_sql").alias("template")).agg(F.count("*").alias("n_queries"))


def _catalog_sql(t_names_cols) -> str:
    vals = ", ".join(f"('{a}', '{b}')" for a, b in t_names_cols)
    return f"catalog AS (SELECT * FROM (VALUES {vals}) v(table_name, column_name))"


_CATALOG_FIXED = [
    ("region", "r_regionkey"), ("region", "r_name"), ("nation", "n_nationkey"), ("nation", "n_name"),
    ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey"),
    ("customer", "c_acctbal"), ("customer", "c_mktsegment"), ("supplier", "s_suppkey"), ("supplier", "s_name"),
    ("supplier", "s_nationkey"), ("supplier", "s_acctbal"), ("part", "p_partkey"), ("part", "p_name"),
    ("part", "p_brand"), ("part", "p_type"), ("part", "p_size"), ("part", "p_retailprice"),
    ("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"),
    ("orders", "o_orderdate"), ("orders", "o_orderpriority"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"),
    ("lineitem", "l_suppkey"), ("lineitem", "l_linenumber"), ("lineitem", "l_quantity"),
    ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("lineitem", "l_returnflag"),
    ("lineitem", "l_linestatus"), ("lineitem", "l_shipdate"), ("events", "event_id"), ("events", "ts"),
    ("events", "user_id"), ("events", "event_type"), ("events", "value"), ("events", "props"),
    ("documents", "doc_id"), ("documents", "text"), ("documents", "lang"), ("documents", "source"),
    ("documents", "n_chars"), ("embeddings", "vec_id"), ("embeddings", "embedding"), ("embeddings", "label"),
    ("pages", "page_id"), ("pages", "url"), ("pages", "html"), ("benchmark", "item_id"), ("benchmark", "text"),
    ("labels", "doc_id"), ("labels", "quality"), ("labels", "toxic"), ("conversations", "conv_id"),
    ("conversations", "turn"), ("conversations", "role"), ("conversations", "text"),
]


@register("L13_relevant_tables", f"""
WITH {QUERY_LOG_SQL}, {_catalog_sql(_CATALOG_FIXED)},
q AS (SELECT query_id, lower(question) AS ql, {sql_tokens('question')} AS qt FROM query_log),
tabs AS (SELECT DISTINCT table_name FROM catalog),
ts AS (SELECT q.query_id, t.table_name,
              (CASE WHEN list_contains(q.qt, t.table_name) OR list_contains(q.qt, rtrim(t.table_name, 's')) OR list_contains(q.qt, t.table_name || 's') THEN 5 ELSE 0 END)
            + (CASE WHEN contains(q.ql, t.table_name) THEN 5 ELSE 0 END) AS s
       FROM q, tabs t),
cs AS (SELECT q.query_id, c.table_name,
              sum((CASE WHEN contains(q.ql, c.column_name) THEN 3 ELSE 0 END)
                + len(list_intersect(q.qt, list_distinct(string_split(c.column_name, '_'))))) AS s
       FROM q JOIN catalog c ON TRUE GROUP BY 1, 2),
tot AS (SELECT ts.query_id, ts.table_name, ts.s + coalesce(cs.s, 0) AS score FROM ts LEFT JOIN cs USING (query_id, table_name)),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM tot)
SELECT query_id, table_name, CAST(score AS BIGINT) AS score, top = 0 AS fallback FROM m WHERE score > 0 OR top = 0
""")
def l13(t: Tables):
    """Relevant tables per question: +5 table name (singular or plural) as
    token, +5 table name inside the text, +3 per column name inside the text,
    +1 per distinct column-name part among the tokens; all tables where
    nothing scores.  Tables and columns are schema metadata, so a question's
    scores are one array expression: no join, no shuffle."""
    cat: dict[str, list[str]] = {}
    for table, column in _CATALOG_FIXED:
        cat.setdefault(table, []).append(column)
    q = query_log(t).select("query_id", F.lower("question").alias("ql"), tokens("question").alias("qt"))

    def score(table):
        names = F.array(*[F.lit(x) for x in dict.fromkeys((table, table.rstrip("s"), table + "s"))])
        s = F.when(F.arrays_overlap("qt", names), 5).otherwise(0) + F.when(F.col("ql").contains(table), 5).otherwise(0)
        for c in cat[table]:
            parts = F.array(*[F.lit(x) for x in dict.fromkeys(c.split("_"))])
            s = s + F.when(F.col("ql").contains(c), 3).otherwise(0) + F.size(F.array_intersect("qt", parts))
        return F.struct(F.lit(table).alias("table_name"), s.cast("bigint").alias("score"))

    scored = q.select("query_id", F.array(*[score(x) for x in cat]).alias("all"))
    hits = F.filter("all", lambda x: x["score"] > 0)
    return (scored.select("query_id", (F.size(hits) == 0).alias("fallback"), F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.col("all"))).alias("x"))
            .select("query_id", "x.table_name", "x.score", "fallback"))


@register("L14_question_mix", f"""
WITH {QUERY_LOG_SQL},
c AS (SELECT CASE WHEN regexp_matches(lower(question), '^(how many|what is the (total|average|highest|lowest|number))') THEN 'scalar'
                  WHEN regexp_matches(lower(question), '\\b(top|first|bottom)\\s+\\d+') THEN 'top_n'
                  WHEN regexp_matches(lower(question), '\\b(trend|monthly|daily|weekly|over time|since)\\b') THEN 'time'
                  WHEN regexp_matches(lower(question), '\\b(compare|versus|vs)\\b') THEN 'compare'
                  WHEN regexp_matches(lower(question), '\\b(per|each|by)\\b') THEN 'breakdown' ELSE 'list' END AS shape,
             TRY_CAST(nullif(regexp_extract(lower(question), '\\b(?:top|first|bottom)\\s+(\\d+)', 1), '') AS INTEGER) AS n
      FROM query_log)
SELECT shape, count(*) AS n_questions, max(n) AS max_n FROM c GROUP BY shape
""")
def l14(t: Tables):
    q = query_log(t).select(question_class("question").alias("shape"), top_n_value("question").alias("n"))
    return q.groupBy("shape").agg(F.count("*").alias("n_questions"), F.max("n").alias("max_n"))


@register("L15_mine_sql_from_text", """
WITH x AS (SELECT role, text,
  CASE WHEN len(regexp_extract_all(text, '(?s)```(?:sql)?\\s*(.*?)```', 1)) > 0
       THEN (SELECT trim(b) FROM unnest(regexp_extract_all(text, '(?s)```(?:sql)?\\s*(.*?)```', 1)) u(b) ORDER BY length(trim(b)) DESC, trim(b) LIMIT 1)
       WHEN regexp_extract(text, '(?is)^\\s*((?:select|with)\\b.*)$', 1) != '' THEN trim(regexp_extract(text, '(?is)^\\s*((?:select|with)\\b.*)$', 1))
       WHEN regexp_extract(text, '(?is)\\b(select\\b[^;]*)', 1) != '' THEN trim(regexp_extract(text, '(?is)\\b(select\\b[^;]*)', 1))
  END AS sql FROM conversations)
SELECT role, count(*) AS n_texts, count(sql) AS n_with_sql, round(count(sql) / count(*), 6) AS sql_rate,
       round(avg(length(sql)), 6) AS avg_sql_chars FROM x GROUP BY role
""")
def l15(t: Tables):
    c = t.conversations.select("role", extract_sql("text").alias("sql"))
    return c.groupBy("role").agg(F.count("*").alias("n_texts"), F.count("sql").alias("n_with_sql"),
                                 F.round(F.count("sql") / F.count("*"), 6).alias("sql_rate"),
                                 F.round(F.avg(F.length("sql")), 6).alias("avg_sql_chars"))


@register("L16_token_budget", """
SELECT source, lang, count(*) AS n_docs,
       CAST(sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 3.5) AS BIGINT)) END) AS BIGINT) AS est_tokens
FROM documents GROUP BY source, lang
""")
def l16(t: Tables):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n_docs"),
                                                     F.sum(token_budget("text")).alias("est_tokens"))

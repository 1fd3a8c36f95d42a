"""Evaluation inputs derived from the driver tables.

* ``result_gold`` / perturbed predictions: a per-customer result table
  (grows with ``orders``) and rule-based variants of it — reordered,
  rounded, case-changed, with dropped and extra rows.
* ``run_log``: one row per (config, query) — the shape of a scored
  evaluation run — built from ``labels`` ⋈ ``documents``: quality and
  non-toxicity are two real paired outcome vectors over the same ids; a
  third config draws its outcome from an md5 of the id.

Every DataFrame here has a DuckDB twin (``*_SQL``) used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Tables


def md5_int(text: Column, start: int = 1, length: int = 8) -> Column:
    """Deterministic integer draw: hex digits of md5(text) as a bigint."""
    return F.conv(F.substring(F.md5(text), start, length), 16, 10).cast("bigint")


def md5_int_sql(text: str, start: int = 1, length: int = 8) -> str:
    return f"('0x' || substr(md5({text}), {start}, {length}))::BIGINT"


# ------------------------------------------------------------ result pairs

def result_gold(t: Tables) -> DataFrame:
    o = t.orders
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"),
                                      F.round(F.sum("o_totalprice"), 2).alias("total"),
                                      F.max("o_orderstatus").alias("top_status"))


RESULT_GOLD_SQL = ("gold AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, "
                   "max(o_orderstatus) AS top_status FROM orders GROUP BY o_custkey)")


def result_pred_keyed(t: Tables) -> DataFrame:
    """Prediction with numeric text, tolerance-level drift, case changes,
    one wrong count class and dropped small customers."""
    g = result_gold(t)
    return g.where(F.col("n_orders") > 5).select(
        "o_custkey",
        F.when(F.col("total") > 3_000_000, F.col("n_orders") + 1).otherwise(F.col("n_orders"))
        .cast("string").alias("n_orders"),
        F.when(F.col("top_status") == "P", F.col("total") * 1.000001).otherwise(F.col("total")).alias("total"),
        F.when(F.col("n_orders") >= 12, F.lower("top_status")).otherwise(F.col("top_status")).alias("top_status"))


RESULT_PRED_KEYED_SQL = RESULT_GOLD_SQL + """, pred AS (SELECT o_custkey,
  CAST(CASE WHEN total > 3000000 THEN n_orders + 1 ELSE n_orders END AS VARCHAR) AS n_orders,
  CASE WHEN top_status = 'P' THEN total * 1.000001 ELSE total END AS total,
  CASE WHEN n_orders >= 12 THEN lower(top_status) ELSE top_status END AS top_status
  FROM gold WHERE n_orders > 5)"""


def result_pred_multiset(t: Tables) -> DataFrame:
    """Same rows minus small customers, plus a duplicate of every large one."""
    g = result_gold(t)
    return g.where(F.col("n_orders") > 5).unionByName(g.where(F.col("n_orders") >= 20))


RESULT_PRED_MULTISET_SQL = RESULT_GOLD_SQL + """, pred AS (SELECT * FROM gold WHERE n_orders > 5
  UNION ALL SELECT * FROM gold WHERE n_orders >= 20)"""


def sql_eq_exact(a: str, b: str, a_float: bool = False, b_float: bool = False) -> str:
    an = f"({a} IS NULL OR isnan({a}))" if a_float else f"({a} IS NULL)"
    bn = f"({b} IS NULL OR isnan({b}))" if b_float else f"({b} IS NULL)"
    af, bf = f"TRY_CAST(trim(CAST({a} AS VARCHAR)) AS DOUBLE)", f"TRY_CAST(trim(CAST({b} AS VARCHAR)) AS DOUBLE)"
    return (f"(CASE WHEN {an} AND {bn} THEN TRUE WHEN {an} OR {bn} THEN FALSE "
            f"WHEN {af} IS NOT NULL AND {bf} IS NOT NULL THEN (NOT isnan({af}) AND NOT isnan({bf}) AND {af} = {bf}) "
            f"ELSE CAST({a} AS VARCHAR) = CAST({b} AS VARCHAR) END)")


def sql_eq_semantic(a: str, b: str, rtol: float = 1e-4, a_float: bool = False, b_float: bool = False) -> str:
    an = f"({a} IS NULL OR isnan({a}))" if a_float else f"({a} IS NULL)"
    bn = f"({b} IS NULL OR isnan({b}))" if b_float else f"({b} IS NULL)"
    af, bf = f"TRY_CAST(trim(CAST({a} AS VARCHAR)) AS DOUBLE)", f"TRY_CAST(trim(CAST({b} AS VARCHAR)) AS DOUBLE)"
    close = (f"(abs({af} - {bf}) <= {rtol} * greatest(abs({af}), abs({bf}), 1.0) OR "
             f"({af} != 0 AND {bf} != 0 AND (abs({af} / {bf} - 100.0) <= 0.01 OR abs({af} / {bf} - 0.01) <= 0.0001)))")
    norm = "regexp_replace(lower(trim(CAST({x} AS VARCHAR))), '\\s+', ' ', 'g')"
    return (f"(CASE WHEN {an} AND {bn} THEN TRUE WHEN {an} OR {bn} THEN FALSE "
            f"WHEN {af} IS NOT NULL AND {bf} IS NOT NULL THEN {close} "
            f"ELSE {norm.format(x=a)} = {norm.format(x=b)} END)")


# ------------------------------------------------------------ run log

CONFIGS = ("cfg_quality", "cfg_clean", "cfg_hash")


def run_log(t: Tables) -> DataFrame:
    """run_log(config, query_id, category, difficulty, executed, correct,
    tokens, latency_ms, error, trial)."""
    base = t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    h = md5_int(F.col("doc_id").cast("string"))
    outcome = {"cfg_quality": F.col("quality"), "cfg_clean": 1 - F.col("toxic"),
               "cfg_hash": F.when(h % 3 != 0, 1).otherwise(0)}
    frames = []
    for i, cfg in enumerate(CONFIGS):
        correct = outcome[cfg].cast("int")
        executed = F.when(correct == 1, 1).when((h + i) % 5 == 0, 0).otherwise(1)
        frames.append(base.select(
            F.lit(cfg).alias("config"), F.col("doc_id").alias("query_id"), F.col("source").alias("category"),
            F.col("lang").alias("difficulty"), executed.alias("executed"), correct.alias("correct"),
            F.ceil(F.col("n_chars") / 3.5).cast("bigint").alias("tokens"),
            (F.col("n_chars") * 0.25 + (h % 1000) + i * 100).cast("double").alias("latency_ms"),
            F.when(executed == 0, F.concat(F.lit("Code: "), ((h + i) % 3 * 13 + 47).cast("string"),
                                           F.lit(". DB::Exception: Missing columns: 'c"),
                                           (h % 10).cast("string"), F.lit("' while processing query"), F.when((h + i) % 4 != 0, " (UNKNOWN_IDENTIFIER)").otherwise("")))
            .when(correct == 0, F.lit(None).cast("string")).alias("error"),
            F.lit(0).alias("trial")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _run_log_sql() -> str:
    h = md5_int_sql("CAST(l.doc_id AS VARCHAR)")
    outcome = {"cfg_quality": "l.quality", "cfg_clean": "1 - l.toxic",
               "cfg_hash": f"CASE WHEN {h} % 3 != 0 THEN 1 ELSE 0 END"}
    parts = []
    for i, cfg in enumerate(CONFIGS):
        c = f"CAST({outcome[cfg]} AS INTEGER)"
        ex = f"(CASE WHEN {c} = 1 THEN 1 WHEN ({h} + {i}) % 5 = 0 THEN 0 ELSE 1 END)"
        parts.append(
            f"SELECT '{cfg}' AS config, l.doc_id AS query_id, d.source AS category, d.lang AS difficulty, "
            f"{ex} AS executed, {c} AS correct, CAST(ceil(d.n_chars / 3.5) AS BIGINT) AS tokens, "
            f"CAST(d.n_chars * 0.25 + ({h} % 1000) + {i * 100} AS DOUBLE) AS latency_ms, "
            f"CASE WHEN {ex} = 0 THEN 'Code: ' || CAST((({h} + {i}) % 3) * 13 + 47 AS VARCHAR) || "
            f"'. DB::Exception: Missing columns: ''c' || CAST({h} % 10 AS VARCHAR) || ''' while processing query' || CASE WHEN ({h} + {i}) % 4 != 0 THEN ' (UNKNOWN_IDENTIFIER)' ELSE '' END "
            f"ELSE NULL END AS error, 0 AS trial "
            f"FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
    return "run_log AS (" + " UNION ALL ".join(parts) + ")"


RUN_LOG_SQL = _run_log_sql()


def scored_run_log(t: Tables) -> DataFrame:
    """run_log plus result row counts, repair fields, comparison details and
    the logged gold / final SQL and question of the same query id."""
    from quarry.plans.querylog_bindings import query_log
    r = run_log(t)
    h = md5_int(F.concat(F.col("config"), F.lit("#"), F.col("query_id").cast("string")))
    gold_rows = h % 40
    pred_rows = (F.when(F.col("correct") == 1, gold_rows).when(F.col("executed") == 0, F.lit(0))
                 .otherwise(md5_int(F.concat(F.lit("r"), F.col("query_id").cast("string"))) % 97))
    rep = ((F.col("correct") == 0) & (h % 2 == 0))
    r = r.select("*", gold_rows.alias("gold_rows"), pred_rows.alias("pred_rows"), rep.alias("repair_attempted"),
                 (rep & (h % 4 == 0)).alias("repair_success"), (h % 7 != 0).alias("model_success"))
    r = r.withColumn("details", F.when(F.col("correct") == 1, "match").when(F.col("executed") == 0, "")
                     .when(F.col("pred_rows") != F.col("gold_rows"), "row-count mismatch")
                     .otherwise("large equal-sized result set"))
    q = query_log(t).select("query_id", "question", "gold_sql", F.col("pred_sql").alias("final_sql"))
    return r.join(q, "query_id", "left")


def _scored_sql() -> str:
    h = md5_int_sql("config || '#' || CAST(query_id AS VARCHAR)")
    hr = md5_int_sql("'r' || CAST(query_id AS VARCHAR)")
    return (f"srl0 AS (SELECT *, {h} % 40 AS gold_rows, "
            f"CASE WHEN correct = 1 THEN {h} % 40 WHEN executed = 0 THEN 0 ELSE {hr} % 97 END AS pred_rows, "
            f"(correct = 0 AND {h} % 2 = 0) AS repair_attempted, (correct = 0 AND {h} % 2 = 0 AND {h} % 4 = 0) AS repair_success, {h} % 7 != 0 AS model_success "
            f"FROM run_log), "
            f"srl1 AS (SELECT *, CASE WHEN correct = 1 THEN 'match' WHEN executed = 0 THEN '' "
            f"WHEN pred_rows != gold_rows THEN 'row-count mismatch' ELSE 'large equal-sized result set' END AS details FROM srl0), "
            f"scored AS (SELECT s.*, q.question, q.gold_sql, q.pred_sql AS final_sql FROM srl1 s "
            f"LEFT JOIN query_log q ON s.query_id = q.query_id)")


def scored_sql() -> str:
    from quarry.plans.querylog_bindings import QUERY_LOG_SQL
    return f"{RUN_LOG_SQL}, {QUERY_LOG_SQL}, {_scored_sql()}"


def outcomes(t: Tables) -> DataFrame:
    """Long paired-outcome table (family=metric, config, query_id, outcome)."""
    r = run_log(t)
    return (r.select("config", "query_id", F.col("correct").alias("o")).withColumn("metric", F.lit("correct"))
            .unionByName(r.select("config", "query_id", F.col("executed").alias("o")).withColumn("metric", F.lit("executed")))
            .select("metric", "config", "query_id", F.col("o").cast("int").alias("outcome")))


OUTCOMES_SQL = (RUN_LOG_SQL + ", outcomes AS (SELECT 'correct' AS metric, config, query_id, CAST(correct AS INTEGER) AS outcome "
                "FROM run_log UNION ALL SELECT 'executed', config, query_id, CAST(executed AS INTEGER) FROM run_log)")

"""P (profiling) and M (metrics, failure analysis) ops over the scored run log."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators.distincts import column_values
from quarry.operators.joins import broadcast_if_small
from quarry.operators.querylog import column_refs, harmonic, normalize_sql, prf1, question_class, table_refs
from quarry.operators.windows import top_n_per_group
from quarry.plans.eval_bindings import CONFIGS, RUN_LOG_SQL, run_log, scored_run_log, scored_sql
from quarry.plans.eval_querylog import LINK_F1_SQL
from quarry.plans.registry import register
from quarry.sources.tables import Tables


@register("P1_table_profile", """
WITH u AS (
  SELECT 'c_custkey' AS column_name, CAST(c_custkey AS VARCHAR) AS v FROM customer
  UNION ALL SELECT 'c_name', c_name FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer),
s AS (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS rn FROM (SELECT DISTINCT column_name, v FROM u WHERE v IS NOT NULL)),
samp AS (SELECT column_name, string_agg(v, '|' ORDER BY v) AS samples FROM s WHERE rn <= 5 GROUP BY 1),
st AS (SELECT 'c_custkey' AS column_name, CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value,
              count(DISTINCT c_custkey) AS n_distinct, round(100.0 * count(*) FILTER (WHERE c_custkey IS NULL) / count(*), 6) AS null_pct FROM customer
       UNION ALL SELECT 'c_name', min(c_name), max(c_name), count(DISTINCT c_name), round(100.0 * count(*) FILTER (WHERE c_name IS NULL) / count(*), 6) FROM customer
       UNION ALL SELECT 'c_nationkey', CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR), count(DISTINCT c_nationkey), round(100.0 * count(*) FILTER (WHERE c_nationkey IS NULL) / count(*), 6) FROM customer
       UNION ALL SELECT 'c_acctbal', CAST(min(c_acctbal) AS VARCHAR), CAST(max(c_acctbal) AS VARCHAR), count(DISTINCT c_acctbal), round(100.0 * count(*) FILTER (WHERE c_acctbal IS NULL) / count(*), 6) FROM customer
       UNION ALL SELECT 'c_mktsegment', min(c_mktsegment), max(c_mktsegment), count(DISTINCT c_mktsegment), round(100.0 * count(*) FILTER (WHERE c_mktsegment IS NULL) / count(*), 6) FROM customer)
SELECT st.*, (SELECT count(*) FROM customer) AS n_rows, samp.samples FROM st LEFT JOIN samp USING (column_name)
""")
def p1(t: Tables):
    """Profile of every column of ``customer``: one wide aggregate (map-side
    combined) for min/max/nulls; distinct counts and the five smallest values
    per column from one unpivoted distinct (WindowGroupLimit)."""
    c = t.customer
    cols = c.columns
    aggs = [F.count("*").alias("n_rows")]
    for x in cols:
        aggs += [F.min(x).cast("string").alias(f"{x}__min"), F.max(x).cast("string").alias(f"{x}__max"),
                 F.round(100.0 * F.count_if(F.col(x).isNull()) / F.count("*"), 6).alias(f"{x}__null")]
    wide = c.agg(*aggs)
    long = wide.select("n_rows", F.inline(F.array(*[F.struct(
        F.lit(x).alias("column_name"), F.col(f"{x}__min").alias("min_value"), F.col(f"{x}__max").alias("max_value"),
        F.col(f"{x}__null").alias("null_pct")) for x in cols])))
    vals = column_values(c)
    top = vals.withColumn("rn", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where("rn <= 5")
    samp = top.groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v"))), lambda s: s["v"]), "|").alias("samples"))
    sizes = vals.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    return (long.join(samp, "column_name", "left").join(sizes, "column_name", "left")
            .select("column_name", "min_value", "max_value", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"), "null_pct", "n_rows", "samples"))


@register("P2_suspicious_results", f"""
WITH {scored_sql()},
c AS (SELECT config, pred_rows, gold_rows, executed,
       CASE WHEN regexp_matches(lower(question), '^(how many|what is the (total|average|highest|lowest|number))') THEN 'scalar'
            WHEN regexp_matches(lower(question), '\\b(top|first|bottom)\\s+\\d+') THEN 'top_n'
            WHEN regexp_matches(lower(question), '\\b(trend|monthly|daily|weekly|over time|since)\\b') THEN 'time'
            WHEN regexp_matches(lower(question), '\\b(compare|versus|vs)\\b') THEN 'compare'
            WHEN regexp_matches(lower(question), '\\b(per|each|by)\\b') THEN 'breakdown' ELSE 'list' END AS shape
      FROM scored)
SELECT config, count(*) FILTER (WHERE executed = 1 AND pred_rows = 0) AS zero_rows,
       count(*) FILTER (WHERE executed = 1 AND pred_rows = 1 AND shape IN ('list', 'breakdown')) AS single_row_list,
       count(*) FILTER (WHERE executed = 1 AND pred_rows > 10000 AND shape = 'top_n') AS huge_top_n,
       count(*) FILTER (WHERE executed = 1 AND gold_rows > 0 AND pred_rows / gold_rows > 5) AS ratio_over_5
FROM c GROUP BY config
""")
def p2(t: Tables):
    s = scored_run_log(t).withColumn("shape", question_class("question"))
    ex = F.col("executed") == 1
    return s.groupBy("config").agg(
        F.count_if(ex & (F.col("pred_rows") == 0)).alias("zero_rows"),
        F.count_if(ex & (F.col("pred_rows") == 1) & F.col("shape").isin("list", "breakdown")).alias("single_row_list"),
        F.count_if(ex & (F.col("pred_rows") > 10000) & (F.col("shape") == "top_n")).alias("huge_top_n"),
        F.count_if(ex & (F.col("gold_rows") > 0) & (F.col("pred_rows") / F.col("gold_rows") > 5)).alias("ratio_over_5"))


def with_link_f1(df):
    """Add ``link_f1``: the overall link F1 (harmonic mean of table and column
    F1) of final against gold SQL, NULL without logged SQL.  The reference
    sets are columns of their own, so each is worked out once a row."""
    d = df.withColumns({"_p": normalize_sql("final_sql"), "_g": normalize_sql("gold_sql")})
    d = d.withColumns({"_tp": table_refs("_p"), "_tg": table_refs("_g"), "_cp": column_refs("_p"), "_cg": column_refs("_g")})
    d = d.withColumns({"_t": prf1(F.col("_tp"), F.col("_tg")), "_c": prf1(F.col("_cp"), F.col("_cg"))})
    f1 = F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.round(harmonic(F.col("_t.f1"), F.col("_c.f1")), 5))
    return d.withColumn("link_f1", f1).drop("_p", "_g", "_tp", "_tg", "_cp", "_cg", "_t", "_c")


def _headline(df, *keys, link: str | None = None):
    more = [F.round(F.avg(link), 5).alias("mean_link_f1")] if link else []
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("executed"), 6).alias("executed_rate"),
        F.round(F.avg("correct"), 6).alias("correct_rate"), F.round(F.avg("tokens"), 2).alias("mean_tokens"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"), F.sum("executed").alias("n_executed"),
        F.sum("correct").alias("n_correct"), *more)


@register("M1_headline_metrics", f"""
WITH {scored_sql()}, {LINK_F1_SQL}
SELECT config, count(*) AS n, round(avg(executed), 6) AS executed_rate, round(avg(correct), 6) AS correct_rate,
       round(avg(tokens), 2) AS mean_tokens, round(avg(latency_ms), 2) AS mean_latency_ms,
       CAST(sum(executed) AS BIGINT) AS n_executed, CAST(sum(correct) AS BIGINT) AS n_correct, round(avg(overall_f1), 5) AS mean_link_f1
FROM scored LEFT JOIN link USING (query_id) GROUP BY config
""")
def m1(t: Tables):
    """Rates, means and the mean overall link F1 of the logged SQL."""
    return _headline(with_link_f1(scored_run_log(t)), "config", link="link_f1")


@register("M2_metrics_by_slice", f"""
WITH {RUN_LOG_SQL}, r AS (SELECT *, replace(lower(category), '-', '_') AS cat FROM run_log)
SELECT config, cat AS category, difficulty, count(*) AS n, round(avg(correct), 6) AS correct_rate,
       round(avg(executed), 6) AS executed_rate
FROM r GROUP BY GROUPING SETS ((config), (config, cat), (config, difficulty))
""")
def m2(t: Tables):
    """Overall, per category and per difficulty in ONE grouping-sets
    aggregation (category normalised first)."""
    r = run_log(t).withColumn("category", F.regexp_replace(F.lower("category"), "-", "_"))
    return r.groupingSets([["config"], ["config", "category"], ["config", "difficulty"]],
                          "config", "category", "difficulty").agg(
        F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("correct_rate"),
        F.round(F.avg("executed"), 6).alias("executed_rate"))


@register("M3_scored_run_summary", f"""
WITH {scored_sql()}
SELECT config, count(*) AS n, count(*) FILTER (WHERE repair_attempted) AS repair_attempts,
       count(*) FILTER (WHERE repair_success) AS repair_successes,
       round(avg(CASE WHEN correct = 1 THEN 1.0 WHEN gold_rows = 0 THEN (CASE WHEN pred_rows = 0 THEN 1.0 ELSE 0.0 END)
                      ELSE least(pred_rows, gold_rows) / gold_rows END), 6) AS mean_partial_score,
       round(avg(correct), 6) AS correct_rate
FROM scored GROUP BY config
""")
def m3(t: Tables):
    s = scored_run_log(t)
    part = (F.when(F.col("correct") == 1, 1.0)
            .when(F.col("gold_rows") == 0, F.when(F.col("pred_rows") == 0, 1.0).otherwise(0.0))
            .otherwise(F.least("pred_rows", "gold_rows") / F.col("gold_rows")))
    return s.groupBy("config").agg(F.count("*").alias("n"), F.count_if("repair_attempted").alias("repair_attempts"),
                                   F.count_if("repair_success").alias("repair_successes"),
                                   F.round(F.avg(part), 6).alias("mean_partial_score"),
                                   F.round(F.avg("correct"), 6).alias("correct_rate"))


# Classes of a wrong answer, first match wins (label, words any of which the gold SQL has, words none
# of which the final SQL has, words any of which the details have); the grouping rule compares the two GROUP BY lists.
FAILURE_RULES = [
    ("Projection mismatch", [], [], ["column count mismatch", "projected gold"]),
    ("Wrong granularity or filter", [], [], ["row-count mismatch"]),
    ("Missing filter assumption", ["countif", " filter ", " where "], [" where ", " filter "], []),
    ("Grouping-key mismatch", "group by", "order by", []),
    ("Join-path mismatch", ["join"], ["join"], []),
    ("JSON/property mismatch", ["properties["], ["properties["], []),
    ("Wrong values or ranking", [], [], ["large equal-sized result set"]),
]


def failure_class():
    """First matching rule wins."""
    details, gold, final = F.lower("details"), F.lower(F.coalesce("gold_sql", F.lit(""))), F.lower(F.coalesce("final_sql", F.lit("")))

    def some(text, words):
        return reduce(or_, [text.contains(w) for w in words])

    def keys(text, start, stop):
        return F.split(F.element_at(F.split(text, start, 2), 2), stop, 2)[0]

    out = F.when(F.col("correct") == 1, "Correct").when(
        F.col("executed") == 0, F.when((F.trim(final) == "") | ~F.coalesce("model_success", F.lit(False)), "Timeout / empty output").otherwise("Residual execution error"))
    for label, has, lacks, said in FAILURE_RULES:
        if isinstance(has, str):
            rule = gold.contains(has) & final.contains(has) & (keys(gold, has, lacks) != keys(final, has, lacks))
        else:
            rule = some(details, said) if said else some(gold, has) & ~some(final, lacks)
        out = out.when(rule, label)
    return out.otherwise("Other wrong result")


def _failure_sql() -> str:
    details, gold, final = "lower(details)", "lower(coalesce(gold_sql, ''))", "lower(coalesce(final_sql, ''))"

    def some(text, words):
        return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"

    def keys(text, start, stop):
        return f"string_split(substr({text}, instr({text}, '{start}') + {len(start)}), '{stop}')[1]"

    out = (f"CASE WHEN correct = 1 THEN 'Correct' WHEN executed = 0 THEN (CASE WHEN trim({final}) = '' OR NOT model_success "
           "THEN 'Timeout / empty output' ELSE 'Residual execution error' END)")
    for label, has, lacks, said in FAILURE_RULES:
        if isinstance(has, str):
            rule = f"{some(gold, [has])} AND {some(final, [has])} AND {keys(gold, has, lacks)} != {keys(final, has, lacks)}"
        else:
            rule = some(details, said) if said else f"{some(gold, has)} AND NOT {some(final, lacks)}"
        out += f" WHEN {rule} THEN '{label}'"
    return out + " ELSE 'Other wrong result' END"


_FAIL_SQL = _failure_sql()


@register("M4_failure_classes", f"""
WITH {scored_sql()}
SELECT config, {_FAIL_SQL} AS failure_class, count(*) AS n FROM scored GROUP BY 1, 2
""")
def m4(t: Tables):
    return scored_run_log(t).groupBy("config", failure_class().alias("failure_class")).agg(F.count("*").alias("n"))


# Assumption tags (label, words any of which must be in the
# question or gold SQL, words any of which must be in the gold SQL, words any
# of which in the question suffice).
ASSUMPTION_TAGS = [
    ("time window / bucket", ["month", "week", "year", "day", "last", "past", "date", "time", "cohort"],
     ["tostartof", "toyear", "tomonth", "date", "timestamp", "start_time"], []),
    ("grouping key", [], ["group by"], []),
    ("filter / predicate", [], ["countif", "sumif", "where", "having"], []),
    ("ranking / tie-break", [], ["order by"], ["top", "rank"]),
    ("join path", [], ["join"], []),
    ("JSON property", [], ["properties[", "json_extract", "mapcontains"], []),
    ("window frame", [], ["over ("], []),
    ("metric definition", [], ["count", "sum", "avg", "quantile"], []),
]


def _tag_sql(both: list[str], gold: list[str], question: list[str]) -> str:
    def any_in(words, text):
        return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
    c = any_in(gold, "g")
    if both:
        c += " AND " + any_in(both, "(nl || g)")
    if question:
        c = f"({c} OR {any_in(question, 'nl')})"
    return c


@register("M5_assumption_tags", f"""
WITH {scored_sql()},
w AS (SELECT config, lower(coalesce(question, '')) AS nl, lower(coalesce(gold_sql, '')) AS g, lower(coalesce(final_sql, '')) AS p
      FROM scored WHERE correct = 0 AND executed = 1),
a AS (SELECT config, g, p, list_filter([{', '.join(f"CASE WHEN {_tag_sql(b, g, q)} THEN '{lbl}' END" for lbl, b, g, q in ASSUMPTION_TAGS)}], lambda v: v IS NOT NULL) AS tags FROM w),
x AS (SELECT config, unnest(CASE WHEN len(tags) = 0 AND p <> '' AND g <> '' AND p <> g THEN ['result shape'] ELSE tags END) AS tag FROM a)
SELECT coalesce(config, 'ALL') AS config, tag, count(*) AS n FROM x GROUP BY GROUPING SETS ((tag), (config, tag))
""")
def m5(t: Tables):
    """Multi-label tags of wrong answers of executed runs, overall and per config."""
    s = scored_run_log(t).where((F.col("correct") == 0) & (F.col("executed") == 1))
    s = s.select("config", *[F.lower(F.coalesce(c, F.lit(""))).alias(n) for c, n in (("question", "nl"), ("gold_sql", "g"), ("final_sql", "p"))])

    def any_in(words, text):
        e = F.lit(False)
        for w in words:
            e = e | text.contains(w)
        return e

    arms = []
    for label, both, gold, question in ASSUMPTION_TAGS:
        c = any_in(gold, F.col("g"))
        if both:
            c = c & any_in(both, F.concat("nl", "g"))
        if question:
            c = c | any_in(question, F.col("nl"))
        arms.append(F.when(c, F.lit(label)))
    s = s.withColumn("tags", F.array_compact(F.array(*arms)))
    shape = (F.size("tags") == 0) & (F.col("p") != "") & (F.col("g") != "") & (F.col("p") != F.col("g"))
    x = s.select("config", F.explode(F.when(shape, F.array(F.lit("result shape"))).otherwise(F.col("tags"))).alias("tag"))
    g = x.groupingSets([["tag"], ["config", "tag"]], "config", "tag").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("config", F.lit("ALL")).alias("config"), "tag", "n")


_ERROR_RE = r"(?s)Code:\s*(\d+).*?DB::Exception:\s*(.*?)(?:\s*\((\w+)\))?\.?\s*$"


@register("M6_error_mix", f"""
WITH {RUN_LOG_SQL},
e AS (SELECT config, error, regexp_matches(error, '{_ERROR_RE}') AS ok, regexp_extract(error, '{_ERROR_RE}', 1) AS code,
             regexp_extract(error, '{_ERROR_RE}', 2) AS message, regexp_extract(error, '{_ERROR_RE}', 3) AS name FROM run_log WHERE error IS NOT NULL)
SELECT config, code, CASE WHEN name = '' THEN 'UNKNOWN' ELSE name END AS name, count(*) AS n,
       count(DISTINCT CASE WHEN ok THEN trim(message) ELSE error END) AS n_messages FROM e GROUP BY 1, 2, 3
""")
def m6(t: Tables):
    """Errors by code and name (in trailing parentheses), with the number of
    distinct whole messages."""
    e = run_log(t).where(F.col("error").isNotNull())
    name = F.regexp_extract("error", _ERROR_RE, 3)
    msg = F.when(F.col("error").rlike(_ERROR_RE), F.trim(F.regexp_extract("error", _ERROR_RE, 2))).otherwise(F.col("error"))
    return (e.select("config", F.regexp_extract("error", _ERROR_RE, 1).alias("code"),
                     F.when(name == "", "UNKNOWN").otherwise(name).alias("name"), msg.alias("message"))
            .groupBy("config", "code", "name").agg(F.count("*").alias("n"), F.countDistinct("message").alias("n_messages")))


@register("M7_failure_listing", f"""
WITH {RUN_LOG_SQL},
f AS (SELECT config, query_id, row_number() OVER (PARTITION BY config ORDER BY query_id) AS rn FROM run_log WHERE correct = 0)
SELECT config, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) FILTER (WHERE rn <= 5) AS first_failures,
       count(*) FILTER (WHERE rn > 5) AS omitted FROM f GROUP BY config
""")
def m7(t: Tables, n: int = 5):
    """First failures per config by a group limit; counts by a plain aggregate."""
    f = run_log(t).where(F.col("correct") == 0).select("config", "query_id")
    first = top_n_per_group(f, ["config"], [F.col("query_id")], n).groupBy("config").agg(F.array_sort(F.collect_list("query_id")).alias("ids"))
    counts = f.groupBy("config").agg(F.count("*").alias("c"))
    return counts.join(broadcast_if_small(first), "config").select(
        "config", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("first_failures"), (F.col("c") - F.size("ids")).alias("omitted"))


_SCORES_SQL = "avg(correct) AS cr, avg(executed) AS er, coalesce(avg(overall_f1), 0.0) AS f1"


def _scores(df, *keys):
    return df.groupBy(*keys).agg(F.avg("correct").alias("cr"), F.avg("executed").alias("er"), F.coalesce(F.round(F.avg("link_f1"), 9), F.lit(0.0)).alias("f1"))


def _linked(t: Tables):
    return with_link_f1(scored_run_log(t))


_ORDER_SQL = "cr DESC, er DESC, round(f1, 9) DESC"


@register("M8_best_config", f"""
WITH {scored_sql()}, {LINK_F1_SQL},
s AS (SELECT config, {_SCORES_SQL} FROM scored LEFT JOIN link USING (query_id) GROUP BY config)
SELECT config, row_number() OVER (ORDER BY {_ORDER_SQL}, config) AS rank, round(cr, 6) AS correct_rate,
       round(er, 6) AS executed_rate, round(f1, 5) AS link_f1, row_number() OVER (ORDER BY {_ORDER_SQL}, config) = 1 AS is_best FROM s
""")
def m8(t: Tables):
    """Configs ranked by (correct rate, executed rate, link F1); the first is
    best.  The window runs over one row per config."""
    rk = F.row_number().over(Window.orderBy(F.col("cr").desc(), F.col("er").desc(), F.col("f1").desc(), F.col("config")))
    return _scores(_linked(t), "config").select("config", rk.alias("rank"), F.round("cr", 6).alias("correct_rate"),
                                                F.round("er", 6).alias("executed_rate"), F.round("f1", 5).alias("link_f1"), (rk == 1).alias("is_best"))


@register("M8_best_per_dimension", f"""
WITH {scored_sql()}, {LINK_F1_SQL}, l AS (SELECT * FROM scored LEFT JOIN link USING (query_id)),
d AS (SELECT 'config' AS dimension, config AS value, {_SCORES_SQL} FROM l GROUP BY 2
      UNION ALL SELECT 'category', category, {_SCORES_SQL} FROM l GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, {_SCORES_SQL} FROM l GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY {_ORDER_SQL}, value) AS rank FROM d)
SELECT dimension, value, rank, round(cr, 6) AS correct_rate, round(er, 6) AS executed_rate, round(f1, 5) AS link_f1 FROM r WHERE rank <= 2
""")
def m8_dimensions(t: Tables, n: int = 2):
    """The best n values of each run dimension by the same three scores, in
    one grouping-sets aggregate (a few values per dimension are ranked)."""
    l = _linked(t).select("config", "category", "difficulty", "correct", "executed", "link_f1")  # noqa: E741
    names = ["config", "category", "difficulty"]
    g = l.groupingSets([[x] for x in names], *names).agg(
        F.avg("correct").alias("cr"), F.avg("executed").alias("er"), F.coalesce(F.round(F.avg("link_f1"), 9), F.lit(0.0)).alias("f1"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 3, "config").when(F.col("gid") == 5, "category").otherwise("difficulty")
    d = g.select(dim.alias("dimension"), F.coalesce(*names).alias("value"), "cr", "er", "f1")
    rk = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("cr").desc(), F.col("er").desc(), F.col("f1").desc(), F.col("value")))
    return (d.withColumn("rank", rk).where(F.col("rank") <= n)
            .select("dimension", "value", "rank", F.round("cr", 6).alias("correct_rate"), F.round("er", 6).alias("executed_rate"), F.round("f1", 5).alias("link_f1")))


@register("M9_category_pivot", f"""
WITH {RUN_LOG_SQL}
SELECT category, {', '.join(f"round(avg(correct) FILTER (WHERE config = '{c}'), 6) AS {c}" for c in CONFIGS)}
FROM run_log GROUP BY category
""")
def m9(t: Tables):
    return (run_log(t).groupBy("category").pivot("config", list(CONFIGS)).agg(F.round(F.avg("correct"), 6))
            .select("category", *CONFIGS))


#: the data sets of the run log: the language of a query's text
DATASETS = ("de", "en", "es", "fr")


@register("M9_dataset_pivot", f"""
WITH {RUN_LOG_SQL}
SELECT config, {', '.join(f"round(avg(correct) FILTER (WHERE difficulty = '{d}'), 6) AS correct_{d}, round(avg(executed) FILTER (WHERE difficulty = '{d}'), 6) AS executed_{d}" for d in DATASETS)}
FROM run_log GROUP BY config
""")
def m9_datasets(t: Tables):
    """Cross-dataset table: correct and executed rate of every config per data set."""
    def rate(col, d):
        return F.round(F.avg(F.when(F.col("difficulty") == d, F.col(col))), 6).alias(f"{col}_{d}")
    return run_log(t).groupBy("config").agg(*[rate(c, d) for d in DATASETS for c in ("correct", "executed")])

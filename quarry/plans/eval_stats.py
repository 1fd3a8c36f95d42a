"""T ops: paired tests, effect sizes, multiplicity correction, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.querylog import later_near_copies
from quarry.operators.stats import (ERFC_COEFFS, MODULUS, binom_two_sided_exact, bootstrap_rate, chi2_sf,
                                    cochrans_q, cohens_h, h_label, holm, mcnemar_p, paired_tables, wilson)
from quarry.plans.eval_bindings import OUTCOMES_SQL, md5_int, outcomes
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import Tables

# ------------------------------------------------------------ SQL twins

_PAIRS_SQL = """pairs AS (
  SELECT a.metric, a.config AS config_a, b.config AS config_b,
         count(*) FILTER (WHERE a.outcome = 1 AND b.outcome = 1) AS n11, count(*) FILTER (WHERE a.outcome = 1 AND b.outcome = 0) AS n10,
         count(*) FILTER (WHERE a.outcome = 0 AND b.outcome = 1) AS n01, count(*) FILTER (WHERE a.outcome = 0 AND b.outcome = 0) AS n00
  FROM outcomes a JOIN outcomes b ON a.metric = b.metric AND a.query_id = b.query_id AND a.config < b.config
  GROUP BY 1, 2, 3)"""


def _erfc_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({z})))"
    poly = f"{ERFC_COEFFS[-1]}"
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = f"({c} + {t} * {poly})"
    ans = f"({t} * exp(-({z}) * ({z}) + {ERFC_COEFFS[0]} + {t} * {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def _exact_sql_lateral(b: str, c: str) -> str:
    n = f"({b} + {c})"
    return (f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2.0 * list_sum(list_transform(range(0, least({b}, {c}) + 1), "
            f"lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) END)")


def _mcnemar_sql(b: str, c: str) -> str:
    n = f"({b} + {c})"
    x = f"(pow(abs({b} - {c}) - 1.0, 2) / {n})"
    return (f"(CASE WHEN {n} = 0 THEN 1.0 WHEN {n} < 25 THEN {_exact_sql_lateral(b, c)} "
            f"ELSE {_erfc_sql(f'sqrt({x} / 2.0)')} END)")


_RATES_SQL = "rates AS (SELECT metric, config, avg(outcome) AS rate, count(*) AS n FROM outcomes GROUP BY 1, 2)"


def _rates(outc):
    return outc.groupBy("metric", "config").agg(F.avg("outcome").alias("rate"), F.count("*").alias("n"))


def _tests(outc):
    p = paired_tables(outc)
    p = p.withColumn("p_value", mcnemar_p(F.col("n10"), F.col("n01")))
    r = _rates(outc)
    ra = r.select("metric", F.col("config").alias("config_a"), F.col("rate").alias("rate_a"))
    rb = r.select("metric", F.col("config").alias("config_b"), F.col("rate").alias("rate_b"))
    p = p.join(ra, ["metric", "config_a"]).join(rb, ["metric", "config_b"])
    p = p.withColumn("h", cohens_h(F.col("rate_a"), F.col("rate_b")))
    return holm(p.select("metric", "config_a", "config_b", "n11", "n10", "n01", "n00", "p_value", "rate_a", "rate_b", "h"),
                "metric", "p_value")


_TESTS_SQL = f"""{_PAIRS_SQL}, {_RATES_SQL},
tests0 AS (SELECT p.*, {_mcnemar_sql('p.n10', 'p.n01')} AS p_value, ra.rate AS rate_a, rb.rate AS rate_b,
                  2.0 * asin(sqrt(ra.rate)) - 2.0 * asin(sqrt(rb.rate)) AS h
           FROM pairs p JOIN rates ra ON ra.metric = p.metric AND ra.config = p.config_a
                        JOIN rates rb ON rb.metric = p.metric AND rb.config = p.config_b),
tests1 AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p_value, config_a, config_b, n11, n10, n01, n00, rate_a, rate_b, h) AS rk,
                  count(*) OVER (PARTITION BY metric) AS m FROM tests0),
tests AS (SELECT metric, config_a, config_b, n11, n10, n01, n00, p_value, rate_a, rate_b, h,
                 CASE WHEN m = 1 THEN p_value ELSE least(1.0, max(p_value * (m - rk + 1)) OVER (PARTITION BY metric ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS p_holm
          FROM tests1)"""


@register("T1s_paired_tables", f"""
WITH {OUTCOMES_SQL}, {_PAIRS_SQL} SELECT * FROM pairs
""")
def t1(t: Tables):
    return paired_tables(outcomes(t))


@register("T2s_mcnemar", f"""
WITH {OUTCOMES_SQL}, {_PAIRS_SQL}
SELECT metric, config_a, config_b, n10 AS b, n01 AS c, round({_mcnemar_sql('n10', 'n01')}, 10) AS p_value,
       round({_exact_sql_lateral('n10', 'n01')}, 8) AS p_exact,
       CASE WHEN n10 + n01 = 0 THEN 'none' WHEN n10 + n01 < 25 THEN 'exact' ELSE 'chi2_cc' END AS method
FROM pairs
""")
def t2(t: Tables):
    """McNemar per config pair: exact binomial below 25 discordant pairs,
    chi-square with continuity correction above; the always-exact p too."""
    p = paired_tables(outcomes(t))
    b, c = F.col("n10"), F.col("n01")
    return p.select("metric", "config_a", "config_b", b.alias("b"), c.alias("c"),
                    F.round(mcnemar_p(b, c), 10).alias("p_value"), F.round(binom_two_sided_exact(b, c), 8).alias("p_exact"),
                    F.when(b + c == 0, "none").when(b + c < 25, "exact").otherwise("chi2_cc").alias("method"))


@register("T3s_cohens_h", f"""
WITH {OUTCOMES_SQL}, {_RATES_SQL},
x AS (SELECT a.metric, a.config AS config_a, b.config AS config_b, 2.0 * asin(sqrt(a.rate)) - 2.0 * asin(sqrt(b.rate)) AS h
      FROM rates a JOIN rates b ON a.metric = b.metric AND a.config < b.config)
SELECT metric, config_a, config_b, round(h, 6) AS h,
       CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS label
FROM x
""")
def t3(t: Tables):
    r = _rates(outcomes(t))
    a = r.select("metric", F.col("config").alias("config_a"), F.col("rate").alias("ra"))
    b = r.select("metric", F.col("config").alias("config_b"), F.col("rate").alias("rb"))
    x = a.join(b, "metric").where(F.col("config_a") < F.col("config_b"))
    h = cohens_h(F.col("ra"), F.col("rb"))
    return x.select("metric", "config_a", "config_b", F.round(h, 6).alias("h"), h_label(h).alias("label"))


@register("T4s_holm", f"""
WITH {OUTCOMES_SQL}, {_TESTS_SQL}
SELECT metric, config_a, config_b, round(p_value, 10) AS p_value, round(p_holm, 10) AS p_holm FROM tests
""")
def t4(t: Tables):
    x = _tests(outcomes(t))
    return x.select("metric", "config_a", "config_b", F.round("p_value", 10).alias("p_value"),
                    F.round("p_holm", 10).alias("p_holm"))


@register("T5s_cochrans_q", f"""
WITH {OUTCOMES_SQL},
k AS (SELECT metric, count(DISTINCT config) AS k FROM outcomes GROUP BY 1),
r AS (SELECT metric, query_id, sum(outcome) AS r FROM outcomes GROUP BY 1, 2),
c AS (SELECT metric, config, sum(outcome) AS c FROM outcomes GROUP BY 1, 2),
rs AS (SELECT metric, sum(r * r) AS sr2, sum(r) AS "N", count(*) AS n_queries FROM r GROUP BY 1),
cs AS (SELECT metric, sum(c * c) AS sc2 FROM c GROUP BY 1),
q AS (SELECT rs.metric, k.k, rs.n_queries,
             CASE WHEN k.k * rs."N" - rs.sr2 = 0 THEN 0.0 ELSE (k.k - 1) * (k.k * cs.sc2 - rs."N" * rs."N") / (k.k * rs."N" - rs.sr2) END AS q
      FROM rs JOIN cs ON rs.metric = cs.metric JOIN k ON rs.metric = k.metric)
SELECT metric, k, n_queries, round(q, 6) AS q, k - 1 AS df, round(exp(-q / 2.0), 10) AS p_value FROM q
""")
def t5(t: Tables):
    """Cochran's Q over the three configs (chi-square tail of any df; three configs here, so the oracle has df 2)."""
    q = cochrans_q(outcomes(t))
    return q.select("metric", "k", "n_queries", F.round("q", 6).alias("q"), "df",
                    F.round(chi2_sf(F.col("q"), F.col("df")), 10).alias("p_value"))


def _boot_sql(group: str, outcomes_cte: str, reps: int = 10000, seed: int = 42) -> str:
    """Binomial quantiles of one draw a replicate, with log-gamma probabilities."""
    g, join = group, lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in group.split(","))
    x = f"((12345 + {seed * 7919}) % {MODULUS} + b * 104729) % {MODULUS}"
    for _ in range(3):
        x = f"(({x}) * 48271) % {MODULUS}"
    return f"""sizes AS (SELECT {g}, count(*) AS n, avg(outcome) AS rate, sum(outcome) AS ones FROM {outcomes_cte} GROUP BY {g}),
cells AS (SELECT {g}, n, ones, unnest(range(greatest(0, CAST(floor(ones - 10 * sqrt(n) - 10) AS BIGINT)), least(n, CAST(ceil(ones + 10 * sqrt(n) + 10) AS BIGINT)) + 1)) AS k FROM sizes WHERE ones > 0 AND ones < n),
pmf AS (SELECT {g}, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(ones / n) + (n - k) * ln(1 - ones / n)) AS p FROM cells),
cdf AS (SELECT {g}, n, k, sum(p) OVER (PARTITION BY {g} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM pmf),
draws AS (SELECT b, ({x} + 0.5) / {MODULUS} AS u FROM (SELECT unnest(range({reps})) AS b)),
means AS (SELECT {', '.join('c.' + c for c in group.split(','))}, d.b, min(c.k) / any_value(c.n) AS m FROM draws d JOIN cdf c ON c.c >= d.u GROUP BY ALL
          UNION ALL SELECT {g}, b, ones / n FROM sizes, draws WHERE ones = 0 OR ones = n),
stats AS (SELECT {g}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, stddev_samp(m) AS se FROM means GROUP BY {g})"""


@register("T6s_bootstrap_interval", f"""
WITH {OUTCOMES_SQL}, {_boot_sql('metric,config', 'outcomes')}
SELECT s.metric, s.config, s.n, round(s.rate, 6) AS rate, round(st.ci_low, 6) AS ci_low, round(st.ci_high, 6) AS ci_high,
       round(st.se, 6) AS se
FROM sizes s JOIN stats st ON s.metric = st.metric AND s.config = st.config
""")
def t6(t: Tables):
    """Percentile bootstrap (10,000 replicates) of each config's rate."""
    b = bootstrap_rate(outcomes(t), ["metric", "config"])
    return b.select("metric", "config", "n", F.round("rate", 6).alias("rate"), F.round("ci_low", 6).alias("ci_low"),
                    F.round("ci_high", 6).alias("ci_high"), F.round("se", 6).alias("se"))


@register("T7s_wilson_interval", f"""
WITH {OUTCOMES_SQL},
r AS (SELECT metric, config, sum(outcome) AS s, count(*) AS n FROM outcomes GROUP BY 1, 2),
w AS (SELECT *, s / n AS p, 1.96 * 1.96 AS z2 FROM r),
c AS (SELECT *, (p + z2 / (2.0 * n)) / (1.0 + z2 / n) AS center,
             1.96 * sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / (1.0 + z2 / n) AS half FROM w)
SELECT metric, config, n, round(p, 6) AS rate, round(center - half, 6) AS ci_low, round(center + half, 6) AS ci_high FROM c
""")
def t7(t: Tables):
    r = outcomes(t).groupBy("metric", "config").agg(F.sum("outcome").alias("s"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("s"), F.col("n"))
    return r.select("metric", "config", "n", F.round(F.col("s") / F.col("n"), 6).alias("rate"),
                    F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"))


def _trials(t: Tables):
    """Two trials of the 'correct' outcome: trial 1 re-draws ~1/9 of verdicts."""
    o = outcomes(t).where(F.col("metric") == "correct")
    flip = md5_int(F.concat(F.col("config"), F.lit("|t1|"), F.col("query_id").cast("string"))) % 9 == 0
    t1_ = o.select("config", "query_id", F.when(flip, 1 - F.col("outcome")).otherwise(F.col("outcome")).alias("outcome"))
    return (o.select("config", "query_id", "outcome").withColumn("trial", F.lit("0"))
            .unionByName(t1_.withColumn("trial", F.lit("1"))))


_TRIALS_SQL = f"""trials AS (
  SELECT config, query_id, outcome, '0' AS trial FROM outcomes WHERE metric = 'correct'
  UNION ALL SELECT config, query_id,
         CASE WHEN ('0x' || substr(md5(config || '|t1|' || CAST(query_id AS VARCHAR)), 1, 8))::BIGINT % 9 = 0 THEN 1 - outcome ELSE outcome END,
         '1' FROM outcomes WHERE metric = 'correct'),
pooled AS (SELECT config, CAST(query_id AS VARCHAR) || '#' || trial AS query_id, outcome, 'pooled' AS trial FROM trials),
tp AS (SELECT config, CAST(query_id AS VARCHAR) AS query_id, outcome, trial FROM trials UNION ALL SELECT * FROM pooled)"""


@register("T8s_repeated_trials", f"""
WITH {OUTCOMES_SQL}, {_TRIALS_SQL}, {_boot_sql('config,trial', 'tp')}
SELECT s.config, s.trial, s.n, round(s.rate, 6) AS rate, round(st.ci_low, 6) AS ci_low, round(st.ci_high, 6) AS ci_high
FROM sizes s JOIN stats st ON s.config = st.config AND s.trial = st.trial
""")
def t8(t: Tables):
    """Per-trial and pooled bootstrap intervals (pooled = both trials' runs)."""
    tr = _trials(t).withColumn("query_id", F.col("query_id").cast("string"))
    pooled = tr.select("config", F.concat(F.col("query_id"), F.lit("#"), F.col("trial")).alias("query_id"), "outcome",
                       F.lit("pooled").alias("trial"))
    b = bootstrap_rate(tr.unionByName(pooled), ["config", "trial"])
    return b.select("config", "trial", "n", F.round("rate", 6).alias("rate"), F.round("ci_low", 6).alias("ci_low"),
                    F.round("ci_high", 6).alias("ci_high"))


@register("T9s_family_report", f"""
WITH {OUTCOMES_SQL}, {_TESTS_SQL}
SELECT metric AS family, config_a, config_b, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b,
       round(p_value, 10) AS p_value, round(p_holm, 10) AS p_holm, round(h, 6) AS h, p_holm < 0.05 AS significant
FROM tests
""")
def t9(t: Tables):
    """Per family (metric): rates, all pairs, McNemar, Holm, Cohen's h, significance."""
    x = _tests(outcomes(t))
    return x.select(F.col("metric").alias("family"), "config_a", "config_b", F.round("rate_a", 6).alias("rate_a"),
                    F.round("rate_b", 6).alias("rate_b"), F.round("p_value", 10).alias("p_value"),
                    F.round("p_holm", 10).alias("p_holm"), F.round("h", 6).alias("h"),
                    (F.col("p_holm") < 0.05).alias("significant"))


_WILSON_SQL = """ci AS (SELECT metric, config, n, rate, (rate + 1.96 * 1.96 / (2.0 * n)) / (1.0 + 1.96 * 1.96 / n) AS center,
  1.96 * sqrt(rate * (1.0 - rate) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1.0 + 1.96 * 1.96 / n) AS half FROM rates)"""


@register("T9s_family_totals", f"""
WITH {OUTCOMES_SQL}, {_TESTS_SQL}, {_WILSON_SQL},
r AS (SELECT metric, query_id, sum(outcome) AS r FROM outcomes GROUP BY 1, 2),
c AS (SELECT metric, config, sum(outcome) AS c FROM outcomes GROUP BY 1, 2),
rs AS (SELECT metric, sum(r * r) AS sr2, sum(r) AS total, count(*) AS n_queries FROM r GROUP BY 1),
cs AS (SELECT metric, sum(c * c) AS sc2, count(*) AS k FROM c GROUP BY 1),
q AS (SELECT rs.metric, n_queries, k, CASE WHEN k * total - sr2 = 0 THEN 0.0 ELSE (k - 1) * (k * sc2 - total * total) / (k * total - sr2) END AS q FROM rs JOIN cs USING (metric)),
n AS (SELECT metric, count(*) AS n_tests, count(*) FILTER (WHERE p_holm < 0.05) AS n_significant FROM tests GROUP BY metric)
SELECT metric AS family, config, ci.n, round(rate, 6) AS rate, round(center - half, 6) AS ci_low, round(center + half, 6) AS ci_high,
  n_queries, round(q, 6) AS cochran_q, k - 1 AS df, round(exp(-q / 2.0), 10) AS cochran_p, n_tests, n_significant
FROM ci JOIN q USING (metric) JOIN n USING (metric)
""")
def t9_totals(t: Tables):
    """Per family and config: rate with Wilson interval, and the family's
    Cochran Q test, number of tests and of significant ones."""
    o = outcomes(t)
    r = _rates(o)
    lo, hi = wilson(F.col("rate") * F.col("n"), F.col("n"))
    n = _tests(o).groupBy("metric").agg(F.count("*").alias("n_tests"), F.count_if(F.col("p_holm") < 0.05).alias("n_significant"))
    q = cochrans_q(o).select("metric", "n_queries", "q", "df")
    return r.join(q, "metric").join(n, "metric").select(
        F.col("metric").alias("family"), "config", "n", F.round("rate", 6).alias("rate"), F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"),
        "n_queries", F.round("q", 6).alias("cochran_q"), "df", F.round(chi2_sf(F.col("q"), F.col("df")), 10).alias("cochran_p"), "n_tests", "n_significant")


@register("T10s_contrast_without_duplicates", f"""
WITH {OUTCOMES_SQL.replace('outcomes AS (', 'outcomes_all AS (')},
dt AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS tk FROM documents),
dup AS (SELECT DISTINCT b.id AS doc_id FROM dt a JOIN dt b ON a.id < b.id
        WHERE len(a.tk) > 0 AND len(b.tk) >= 0.8 * len(a.tk) AND len(a.tk) >= 0.8 * len(b.tk)
          AND len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) >= 0.8),
outcomes AS (SELECT * FROM outcomes_all WHERE query_id NOT IN (SELECT doc_id FROM dup)),
{_TESTS_SQL}
SELECT metric, config_a, config_b, n10 + n01 AS discordant, round(p_value, 10) AS p_value, round(p_holm, 10) AS p_holm,
       round(h, 6) AS h FROM tests
""")
def t10(t: Tables):
    """Paired contrasts after dropping queries flagged as near-duplicates
    (the later id of every Jaccard >= 0.8 document pair)."""
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    dup = later_near_copies(d).withColumnRenamed("id", "query_id")
    # the battery reads the outcomes in four branches; keep the (run-log
    # sized) de-duplicated table instead of re-running the similarity join
    path = scratch_path(t.spark, "outcomes")
    outcomes(t).join(dup, "query_id", "left_anti").write.parquet(path)
    o = t.spark.read.parquet(path)
    x = _tests(o)
    return x.select("metric", "config_a", "config_b", (F.col("n10") + F.col("n01")).alias("discordant"),
                    F.round("p_value", 10).alias("p_value"), F.round("p_holm", 10).alias("p_holm"),
                    F.round("h", 6).alias("h"))

"""Paired significance tests, effect sizes and intervals as DataFrame jobs.

All tests are computed for every config pair / family at once: a 2x2 table
is a self-join of the long outcome table on (metric, query_id) — each
query pairs only with itself across the (few) configs — and the p-values
are column expressions, so no outcome vector is ever collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


LN2 = 0.6931471805599453

# Erfc rational approximation coefficients (fractional
# error < 1.2e-7), used for the chi-square(1) tail.
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398,
               1.48851587, -0.82215223, 0.17087277]


def erfc(z: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(z))
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + F.lit(ERFC_COEFFS[0]) + t * poly)
    return F.when(z >= 0, ans).otherwise(2.0 - ans)


def paired_tables(outc: DataFrame) -> DataFrame:
    """T1s: 2x2 counts for every (metric, config_a < config_b) pair."""
    a = outc.select("metric", "query_id", F.col("config").alias("config_a"), F.col("outcome").alias("oa"))
    b = outc.select("metric", "query_id", F.col("config").alias("config_b"), F.col("outcome").alias("ob"))
    j = a.join(b, ["metric", "query_id"]).where(F.col("config_a") < F.col("config_b"))
    return j.groupBy("metric", "config_a", "config_b").agg(
        F.count_if((F.col("oa") == 1) & (F.col("ob") == 1)).alias("n11"),
        F.count_if((F.col("oa") == 1) & (F.col("ob") == 0)).alias("n10"),
        F.count_if((F.col("oa") == 0) & (F.col("ob") == 1)).alias("n01"),
        F.count_if((F.col("oa") == 0) & (F.col("ob") == 0)).alias("n00"))


def binom_tail_half(n: int, k: int) -> float:
    """P[X <= k] for X ~ Bin(n, 1/2), k <= n / 2: the largest term from
    log-gammas, the smaller ones as ratios to it, so nothing overflows."""
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * LN2
    total, term, i = 1.0, 1.0, k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    return math.exp(largest + math.log(total))


@F.pandas_udf(T.DoubleType())
def _two_sided(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else 1.0 if x + y == 0
                      else min(1.0, 2.0 * binom_tail_half(int(x + y), int(min(x, y)))) for x, y in zip(b, c)], dtype="float64")


def binom_two_sided_exact(b: Column, c: Column) -> Column:
    """Exact two-sided sign-test p: min(1, 2 * P[X <= min(b, c)]), X ~ Bin(b + c, 1/2);
    a batch of the few test rows at a time."""
    return _two_sided(b.cast("bigint"), c.cast("bigint"))


def _small_exact(b: Column, c: Column, limit: int = 25) -> Column:
    """The same below ``limit`` discordant pairs, as a plain expression."""
    n, k = b + c, F.least(b, c)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("acc")),
        lambda s, i: F.struct((s["t"] * (n - i + 1) / i).alias("t"), (s["acc"] + F.when(i <= k, s["t"] * (n - i + 1) / i).otherwise(0.0)).alias("acc")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * terms["acc"] / F.pow(F.lit(2.0), n)))


def mcnemar_p(b: Column, c: Column) -> Column:
    """p = 1 without discordant pairs; exact binomial below 25 discordant;
    else chi-square with continuity correction (1 df tail = erfc(sqrt(x/2)))."""
    n = b + c
    x = F.pow(F.abs(b - c) - 1.0, 2) / n
    return (F.when(n == 0, 1.0).when(n < 25, _small_exact(b, c))
            .otherwise(erfc(F.sqrt(x / 2.0))))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2.0 * F.asin(F.sqrt(p1)) - 2.0 * F.asin(F.sqrt(p2))


def h_label(h: Column) -> Column:
    a = F.abs(h)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def holm(df: DataFrame, family: str, p: str, out: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p per family: running max of p*(m-rank+1), capped at 1.
    A family is one test battery (a handful of rows)."""
    w = Window.partitionBy(family).orderBy(F.col(p), *[c for c in df.columns if c not in (family, p)])
    m = F.count("*").over(Window.partitionBy(family))
    d = df.withColumn("_rk", F.row_number().over(w)).withColumn("_m", m)
    d = d.withColumn("_adj", F.col(p) * (F.col("_m") - F.col("_rk") + 1))
    run = F.max("_adj").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (d.withColumn(out, F.when(F.col("_m") == 1, F.col(p)).otherwise(F.least(F.lit(1.0), run)))
            .drop("_rk", "_m", "_adj"))


def chi2_tail(x: float, df: int) -> float:
    """Chi-square survival function for any whole df >= 1, by the recurrence
    Q(a + 1, y) = Q(a, y) + y^a e^-y / Gamma(a + 1) from a = 1/2 or 1."""
    y = x / 2.0
    if y <= 0:
        return 1.0
    a, q = (0.5, math.erfc(math.sqrt(y))) if df % 2 else (1.0, math.exp(-y))
    while a < df / 2.0:
        q += math.exp(a * math.log(y) - y - math.lgamma(a + 1))
        a += 1.0
    return min(1.0, q)


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else 1.0 if b < 1 else chi2_tail(float(a), int(b)) for a, b in zip(x, df)], dtype="float64")


def chi2_sf(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("bigint"))


def cochrans_q(outc: DataFrame) -> DataFrame:
    """T5s per metric: Q, df, p (chi-square tail), k configs, n queries."""
    k = outc.groupBy("metric").agg(F.countDistinct("config").alias("k"))
    rows = outc.groupBy("metric", "query_id").agg(F.sum("outcome").alias("r"))
    cols = outc.groupBy("metric", "config").agg(F.sum("outcome").alias("c"))
    rs = rows.groupBy("metric").agg(F.sum(F.col("r") * F.col("r")).alias("sr2"), F.sum("r").alias("N"),
                                    F.count("*").alias("n_queries"))
    cs = cols.groupBy("metric").agg(F.sum(F.col("c") * F.col("c")).alias("sc2"))
    j = rs.join(cs, "metric").join(k, "metric")
    num = (F.col("k") - 1) * (F.col("k") * F.col("sc2") - F.col("N") * F.col("N"))
    den = F.col("k") * F.col("N") - F.col("sr2")
    q = F.when(den == 0, 0.0).otherwise(num.cast("double") / den)
    return j.select("metric", "k", "n_queries", q.alias("q"), (F.col("k") - 1).alias("df"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes.cast("double") / n
    z2 = z * z
    denom = 1.0 + z2 / n
    center = (p + z2 / (2.0 * n)) / denom
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / denom
    return center - half, center + half


MODULUS = 2147483647  # 2^31 - 1


def _binomial_replicates(n: int, successes: int, u: np.ndarray) -> np.ndarray:
    """Success counts of resamples of n outcomes with ``successes`` ones: the
    Bin(n, successes / n) quantiles of the uniform draws ``u``."""
    if successes in (0, n):
        return np.full(len(u), successes)
    p = successes / n
    spread = 9.0 * math.sqrt(n * p * (1 - p)) + 9
    lo, hi = max(0, math.floor(successes - spread)), min(n, math.ceil(successes + spread))
    k = np.arange(lo, hi)
    log_pmf = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1.0)) + math.log(p / (1 - p)))])
    pmf = np.exp(log_pmf - log_pmf.max())
    cdf = np.cumsum(pmf) / pmf.sum()
    return lo + np.minimum(np.searchsorted(cdf, u, side="left"), hi - lo)


def bootstrap_rate(outc: DataFrame, group: list[str], replicates: int = 10000, seed: int = 42) -> DataFrame:
    """T6s: percentile bootstrap of the mean of 0/1 outcomes per group.

    A resample of n outcomes is determined by its number of ones, which is
    Bin(n, rate); replicate b takes the binomial quantile of one
    deterministic uniform draw from (seed, b).  Groups are reduced to
    (n, ones) by a map-side combined aggregate; a group then costs its
    replicates and a table of about 18 standard deviations of counts,
    whatever its number of rows.  The replicate rates give the 2.5 / 97.5
    percentiles and the standard error."""
    sizes = outc.groupBy(*group).agg(F.count("outcome").alias("n"), F.sum(F.col("outcome").cast("bigint")).alias("ones"),
                                     F.avg("outcome").alias("rate")).where("n > 0")
    schema = sizes.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", ci_low double, ci_high double, se double"

    def fold(batches):
        x = (12345 + seed * 7919) % MODULUS
        x = (x + np.arange(replicates, dtype=np.int64) * 104729) % MODULUS
        for _ in range(3):
            x = (x * 48271) % MODULUS
        u = (x + 0.5) / MODULUS
        for pdf in batches:
            rates = [_binomial_replicates(int(n), int(s), u) / n for n, s in zip(pdf["n"], pdf["ones"])]
            yield pdf.assign(ci_low=[np.quantile(m, 0.025) for m in rates], ci_high=[np.quantile(m, 0.975) for m in rates],
                             se=[m.std(ddof=1) for m in rates])

    return sizes.mapInPandas(fold, schema).drop("ones")

"""Paired statistics against published check values."""

import math

from pyspark.sql import functions as F

from quarry.operators.stats import binom_two_sided_exact, cohens_h, holm, mcnemar_p, wilson


def _p(spark, b, c, fn=binom_two_sided_exact):
    return spark.range(1).select(fn(F.lit(b), F.lit(c)).alias("p")).first()["p"]


def test_exact_binomial_published(spark):
    assert abs(_p(spark, 15, 9) - 0.30745625) < 1e-7
    assert abs(_p(spark, 7, 5) - 0.7744140625) < 1e-10
    p = _p(spark, 76, 3)
    assert abs(math.log10(p) - math.log10(2.72e-19)) < 0.01
    assert _p(spark, 0, 0) == 1.0


def test_mcnemar_chi_square(spark):
    # 30 vs 10 discordant: chi2 = (|30-10|-1)^2/40 = 9.025, p = erfc(sqrt(9.025/2))
    p = _p(spark, 30, 10, mcnemar_p)
    assert abs(p - math.erfc(math.sqrt(9.025 / 2))) < 1e-6


def test_cohens_h_and_wilson(spark):
    h = spark.range(1).select(cohens_h(F.lit(0.6), F.lit(0.5)).alias("h")).first()["h"]
    assert abs(h - (2 * math.asin(math.sqrt(0.6)) - 2 * math.asin(math.sqrt(0.5)))) < 1e-12
    lo, hi = wilson(F.lit(50), F.lit(100))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(r["lo"] - 0.4038) < 1e-4 and abs(r["hi"] - 0.5962) < 1e-4


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "fam string, t string, p double")
    r = {x["t"]: x["p_holm"] for x in holm(df, "fam", "p").collect()}
    assert abs(r["a"] - 0.03) < 1e-12 and abs(r["c"] - 0.06) < 1e-12 and abs(r["b"] - 0.06) < 1e-12


def test_exact_tail_equals_integer_arithmetic():
    from quarry.operators.stats import binom_tail_half
    for n in (10, 25, 200, 1030, 1100, 1500, 10_000):
        for k in sorted({0, 1, n // 10, n // 3, n // 2 - 7, n // 2}):
            if 0 <= k <= n // 2:
                exact = sum(math.comb(n, i) for i in range(k + 1))
                got = binom_tail_half(n, k)
                want = math.exp(math.log(exact) - n * math.log(2))
                assert got == want or abs(got - want) <= 1e-9 * want, (n, k)


def test_exact_p_far_from_overflow(spark):
    assert _p(spark, 1140, 296) < 1e-100
    assert abs(_p(spark, 600, 500) - 0.0028) < 1e-4


def test_chi_square_tail_of_any_df():
    from quarry.operators.stats import chi2_tail
    for x, df, p in [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (15.08627246938899, 5, 0.01)]:
        assert abs(chi2_tail(x, df) - p) < 1e-9


def test_bootstrap_is_the_binomial_resample(spark):
    from quarry.operators.stats import bootstrap_rate
    rows = [("a", int(i % 10 < 3)) for i in range(2000)] + [("b", 1)] * 7 + [(None, i % 2) for i in range(50)]
    got = {r["g"]: r for r in bootstrap_rate(spark.createDataFrame(rows, "g string, outcome int"), ["g"]).collect()}
    assert got["a"]["n"] == 2000 and abs(got["a"]["se"] - math.sqrt(0.3 * 0.7 / 2000)) < 4e-4
    assert abs(got["a"]["ci_low"] - 0.28) < 0.002 and abs(got["a"]["ci_high"] - 0.32) < 0.002
    assert got["b"]["ci_low"] == got["b"]["ci_high"] == 1.0 and got[None]["n"] == 50
    big = spark.createDataFrame([("x", 1)], "g string, outcome int")
    assert bootstrap_rate(big, ["g"]).first()["se"] == 0.0

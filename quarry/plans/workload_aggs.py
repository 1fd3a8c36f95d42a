"""A ops: global, grouped, conditional, distinct, quantile, arg-max,
collect, HAVING, totals, two-level and histogram aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import or_zero, pct, ratio
from quarry.operators.distincts import (SKETCH_ERROR, count_bitmaps, distinct_if, estimate_sketches,
                                        write_distinct_bitmaps, write_distinct_sketches)
from quarry.operators.ranking import exact_quantiles, null_safe_join, ranked
from quarry.operators.relational import arr_str
from quarry.operators.windows import top_n_per_group
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import Tables



@register("A1_global_aggregates", """
SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price,
       min(l_discount) AS min_disc, max(l_discount) AS max_disc FROM lineitem
""")
def a1(t: Tables):
    return t.lineitem.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                          F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
                          F.min("l_discount").alias("min_disc"), F.max("l_discount").alias("max_disc"))


@register("A2_grouped_multi_key", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def a2(t: Tables):
    li = t.lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(li.l_extendedprice * (1 - li.l_discount)), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@register("A3_group_by_expression", """
SELECT CAST(ts AS DATE) AS event_date, count(*) AS daily_events FROM events GROUP BY event_date
""")
def a3(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("event_date")).agg(F.count("*").alias("daily_events"))


@register("A4_exact_distinct", """
SELECT event_type, count(DISTINCT user_id) AS distinct_users FROM events GROUP BY event_type
""")
def a4(t: Tables):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("distinct_users"))


@register("A5_approx_distinct")
def a5(t: Tables):
    """Approximate distinct users per event type (HyperLogLog++, 1% rsd).
    Engine-specific sketch, so verified rows-only plus a unit test bound."""
    # apart: beside a distinct count, each (event type, user) group would hold a sketch of its own
    approx = t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("approx_users"))
    exact = t.events.groupBy(F.col("event_type").alias("_type")).agg(F.countDistinct("user_id").alias("exact_users"))
    return approx.join(exact, F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


@register("A6_conditional_ratio", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS fulfilled,
       round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 6) AS fulfilled_pct
FROM orders GROUP BY o_orderpriority
""")
def a6(t: Tables):
    f = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_orderpriority").agg(f.alias("fulfilled"),
                                                   F.round(pct(f, F.count("*")), 6).alias("fulfilled_pct"))


@register("A7_conditional_sum_avg_min", """
SELECT o_orderpriority,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS fulfilled_value,
       round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS avg_open_value,
       min(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS first_pending
FROM orders GROUP BY o_orderpriority
""")
def a7(t: Tables):
    o = t.orders
    return o.groupBy("o_orderpriority").agg(
        F.round(F.coalesce(F.sum(F.when(o.o_orderstatus == "F", o.o_totalprice)), F.lit(0.0)), 2).alias("fulfilled_value"),
        F.round(F.avg(F.when(o.o_orderstatus == "O", o.o_totalprice)), 6).alias("avg_open_value"),
        F.min(F.when(o.o_orderstatus == "P", o.o_orderdate)).alias("first_pending"))


@register("A8_conditional_distinct", """
SELECT CAST(ts AS DATE) AS day,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewers,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clickers,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchasers
FROM events GROUP BY day
""")
def a8(t: Tables):
    """One (day, user) row with flags, no copy of a row per count."""
    kind = F.col("event_type")
    e = t.events.select(F.to_date("ts").alias("day"), "user_id", "event_type")
    return distinct_if(e, ["day"], "user_id", {"viewers": kind == "view", "clickers": kind == "click", "purchasers": kind == "purchase"})


_PERIODS = "(VALUES ('day'), ('week'), ('month')) AS g(grain)"
_PERIOD_SQL = "CAST(date_trunc(grain, ts) AS DATE)"


def _by_period(daily):
    """Rows of days as rows of days, ISO weeks and months."""
    return daily.select("*", F.inline(F.array(*[F.struct(F.lit(g).alias("grain"), F.to_date(F.date_trunc(g, "day")).alias("period")) for g in ("day", "week", "month")])))


@register("A8_distinct_rollup", f"""
SELECT grain, {_PERIOD_SQL} AS period, event_type, count(DISTINCT user_id) AS users
FROM events, {_PERIODS} WHERE user_id IS NOT NULL GROUP BY ALL
""")
def a8_rollup(t: Tables):
    """Exact distinct users of every day, week and month by kind of event,
    all from one stored set of bitmaps a day: weeks and months are ORs of
    days, the events are read once."""
    path = scratch_path(t.spark, "user-bitmaps")
    write_distinct_bitmaps(t.events.where("user_id is not null").select(F.to_date("ts").alias("day"), "event_type", "user_id"), ["day", "event_type"], "user_id", path)
    return count_bitmaps(_by_period(t.spark.read.parquet(path)), ["grain", "period", "event_type"], "users")


@register("A5_sketch_rollup", f"""
SELECT grain, {_PERIOD_SQL} AS period, count(DISTINCT user_id) AS exact_users, true AS within_bound
FROM events, {_PERIODS} WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
""")
def a5_rollup(t: Tables):
    """Approximate distinct users of every day, week and month from one stored
    sketch a day, held against the exact numbers: ``within_bound`` says that
    the estimate is within three standard errors (and half a user)."""
    e = t.events.where("user_id is not null and ts is not null").select(F.to_date("ts").alias("day"), "user_id")
    sketches, bitmaps = scratch_path(t.spark, "user-sketches"), scratch_path(t.spark, "user-bitmaps")
    write_distinct_sketches(e, ["day"], "user_id", sketches)
    write_distinct_bitmaps(e, ["day"], "user_id", bitmaps)
    estimate = estimate_sketches(_by_period(t.spark.read.parquet(sketches)), ["grain", "period"], "estimate")
    exact = count_bitmaps(_by_period(t.spark.read.parquet(bitmaps)), ["grain", "period"], "exact_users")
    close = F.abs(F.col("estimate") - F.col("exact_users")) <= 3 * SKETCH_ERROR * F.col("exact_users") + 0.5
    return exact.join(estimate, ["grain", "period"]).select("grain", "period", "exact_users", close.alias("within_bound"))


@register("A9_quantiles", """
SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95
FROM events WHERE value > 0 GROUP BY event_type
""")
def a9(t: Tables):
    """quantile(0.95) / quantiles(.25,.5,.75) / median, exact and interpolated,
    via a distributed sort (no group is buffered whole in one task)."""
    q = exact_quantiles(t.events.where(F.col("value") > 0), "value", [0.25, 0.5, 0.75, 0.95], ["event_type"],
                        names=["p25", "p50", "p75", "p95"])
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ["p25", "p50", "p75", "p95"]])


@register("A10_arg_max_min", """
SELECT n.n_name AS nation, arg_max(c.c_name, (c.c_acctbal, c.c_custkey)) AS richest,
       arg_min(c.c_name, (c.c_acctbal, -c.c_custkey)) AS poorest, max(c.c_acctbal) AS max_bal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
""")
def a10(t: Tables):
    """argMax/argMin with a deterministic tie-break carried in a struct key."""
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("nation")).agg(
        F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("richest"),
        F.min_by("c_name", F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("poorest"),
        F.max("c_acctbal").alias("max_bal"))


@register("A11_collect_arrays", """
SELECT p_type,
       array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands,
       array_to_string([x.n FOR x IN list_sort(list({'pr': -p_retailprice, 'k': p_partkey, 'n': p_name}))[1:3]], '|') AS top3_by_price
FROM part GROUP BY p_type
""")
def a11(t: Tables):
    """groupUniqArray (distinct brands: bounded by the brand domain) and
    groupArray(3) ordered by price (a max_by-style top-3, never relying on
    input order)."""
    p = t.part
    brands = p.groupBy("p_type").agg(arr_str(F.collect_set("p_brand")).alias("brands"))
    # top 3 per type first (a group limit below the shuffle), so the collected
    # array never holds more than three entries
    top = top_n_per_group(p, ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)
    top3 = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("pr"), F.col("p_partkey").alias("k"),
                                                F.col("p_name").alias("n"))))
    names = top.groupBy("p_type").agg(F.array_join(F.transform(top3, lambda x: x["n"]), "|").alias("top3_by_price"))
    return brands.join(names, "p_type")


@register("A12_having", """
SELECT plan, country, count(*) AS user_count, round(sum(lifetime_value), 2) AS total_ltv,
       round(avg(lifetime_value), 6) AS avg_ltv
FROM users GROUP BY plan, country HAVING sum(lifetime_value) > 50000 AND count(*) >= 10
""", bind=("users",))
def a12(t: Tables):
    g = t.users.groupBy("plan", "country").agg(F.count("*").alias("user_count"),
                                               F.sum("lifetime_value").alias("_s"),
                                               F.round(F.avg("lifetime_value"), 6).alias("avg_ltv"))
    return g.where((F.col("_s") > 50000) & (F.col("user_count") >= 10)) \
        .select("plan", "country", "user_count", F.round("_s", 2).alias("total_ltv"), "avg_ltv")


@register("A13_weighted_average", """
SELECT p_type, round(sum(p_size * p_retailprice) / sum(p_retailprice), 6) AS weighted_size, count(*) AS n
FROM part GROUP BY p_type
""")
def a13(t: Tables):
    p = t.part
    return p.groupBy("p_type").agg(F.round(ratio(F.sum(p.p_size * p.p_retailprice), F.sum("p_retailprice")), 6)
                                   .alias("weighted_size"), F.count("*").alias("n"))


@register("A14_with_totals", """
SELECT event_type, count(*) AS event_count FROM events GROUP BY GROUPING SETS ((event_type), ())
""")
def a14(t: Tables):
    """GROUP BY … WITH TOTALS: the grand-total row has event_type NULL."""
    return t.events.groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("event_count"))


@register("A15_two_level", """
WITH per_user AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS cnt FROM events GROUP BY 1, 2)
SELECT day, arg_max(user_id, (cnt, -user_id)) AS top_user, max(cnt) AS max_events, count(*) AS active_users
FROM per_user GROUP BY day
""")
def a15(t: Tables):
    per_user = t.events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("cnt"))
    return per_user.groupBy("day").agg(F.max_by("user_id", F.struct(F.col("cnt"), -F.col("user_id"))).alias("top_user"),
                                       F.max("cnt").alias("max_events"), F.count("*").alias("active_users"))


@register("A16_stddev_pop", """
SELECT event_type, round(stddev_pop(value), 6) AS std_value, round(avg(value), 6) AS mean_value
FROM events GROUP BY event_type
""")
def a16(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("std_value"),
                                              F.round(F.avg("value"), 6).alias("mean_value"))


@register("A17_histogram_share", """
SELECT CAST(floor(value / 10) * 10 AS BIGINT) AS bucket_start, CAST(floor(value / 10) * 10 + 9 AS BIGINT) AS bucket_end,
       count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS pct
FROM events GROUP BY 1, 2
""")
def a17(t: Tables):
    e = t.events
    total = F.broadcast(e.agg(F.count("*").alias("_total")))  # one row
    b = (F.floor(e.value / 10) * 10).cast("bigint")
    h = e.groupBy(b.alias("bucket_start"), (b + 9).alias("bucket_end")).agg(F.count("*").alias("n"))
    return h.crossJoin(total).select("bucket_start", "bucket_end", "n",
                                     F.round(pct("n", "_total"), 2).alias("pct"))


@register("A18_avg_per_distinct_day", """
SELECT hour(ts) AS hour_of_day, count(*) AS total_events,
       round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS avg_events_per_day
FROM events GROUP BY hour_of_day
""")
def a18(t: Tables):
    e = t.events
    return e.groupBy(F.hour("ts").alias("hour_of_day")).agg(
        F.count("*").alias("total_events"),
        F.round(ratio(F.count("*"), F.countDistinct(F.to_date("ts"))), 6).alias("avg_events_per_day"))


@register("F17_number_functions", """
WITH e AS (SELECT event_type, value, prop_k FROM event_facts)
SELECT event_type, list_sort(array_agg(value) FILTER (WHERE value IS NOT NULL))[CAST(floor(0.5 * count(value)) AS BIGINT) + 1] AS exact_median,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS sum_whole, round(sum(coalesce(TRY_CAST(prop_k AS DOUBLE), 0.0)), 4) AS sum_k_or_zero
FROM e GROUP BY event_type
""", bind=("event_facts",))
def f17(t: Tables):
    """Exact quantile that is an element (no interpolation), whole unsigned
    numbers, and numbers parsed from text with 0 where there is none."""
    e = t.event_facts.select("event_type", "value", "prop_k")
    sums = e.groupBy("event_type").agg(F.count("value").alias("_n"), F.sum(F.col("value").cast("bigint")).alias("sum_whole"),
                                       F.round(F.sum(or_zero("prop_k")), 4).alias("sum_k_or_zero"))
    counts = e.where(F.col("value").isNotNull()).groupBy("event_type", "value").agg(F.count("*").alias("_c"))
    upto = null_safe_join(ranked(counts, [F.col("value")], ["event_type"], running=[("sum", "_c", "_upto")]), sums, ["event_type"])
    return (upto.where(F.col("_upto") >= F.floor(F.col("_n") * 0.5) + 1).groupBy("event_type")
            .agg(F.min("value").alias("exact_median"), F.first("sum_whole").alias("sum_whole"), F.first("sum_k_or_zero").alias("sum_k_or_zero")))

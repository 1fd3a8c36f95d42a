"""W ops: ranking, offsets, running/moving frames, partition aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import boundary_diff, pct
from quarry.operators.joins import skew_join
from quarry.operators.ranking import exact_quantiles, moving_frame, null_safe_join, ranked, shifted
from quarry.operators.windows import frame, growth_pct, running, top_n_per_group
from quarry.plans.registry import register
from quarry.sources.tables import Tables

# per-user event order with the event id as tie-break
def _uw():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@register("W1_row_number", """
SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq
FROM events
""")
def w1(t: Tables):
    """Per-user sequence numbers, skew-safe (a hot user is range-split)."""
    e = t.events.select("user_id", "event_id", "event_type", "ts")
    return ranked(e, [F.col("ts"), F.col("event_id")], ["user_id"], row_number="event_seq")


@register("W2_rank_dense_rank", """
SELECT user_id, plan, lifetime_value,
       rank() OVER (PARTITION BY plan ORDER BY lifetime_value DESC) AS ltv_rank,
       dense_rank() OVER (PARTITION BY plan ORDER BY round(lifetime_value, -3) DESC) AS ltv_band_rank
FROM users
""", bind=("users",))
def w2(t: Tables):
    """rank / dense_rank inside five plan groups: low-cardinality groups,
    so the skew-safe range-partitioned ranking is used."""
    u = t.users.select("user_id", "plan", "lifetime_value")
    r = ranked(u, [F.col("lifetime_value").desc()], ["plan"], rank="ltv_rank")
    b = ranked(r.withColumn("_band", F.round("lifetime_value", -3)), [F.col("_band").desc()], ["plan"],
               dense_rank="ltv_band_rank")
    return b.select("user_id", "plan", "lifetime_value", "ltv_rank", "ltv_band_rank")


@register("W3_ntile", """
SELECT user_id, lifetime_value, ntile(4) OVER (ORDER BY lifetime_value, user_id) AS ltv_quartile,
       ntile(5) OVER (PARTITION BY plan ORDER BY lifetime_value DESC, user_id) AS plan_quintile
FROM users
""", bind=("users",))
def w3(t: Tables):
    """Global ntile (no PARTITION BY) and per-plan ntile without a single-task window."""
    u = t.users.select("user_id", "plan", "lifetime_value")
    g = ranked(u, [F.col("lifetime_value"), F.col("user_id")], ntile=("ltv_quartile", 4))
    p = ranked(g, [F.col("lifetime_value").desc(), F.col("user_id")], ["plan"], ntile=("plan_quintile", 5))
    return p.select("user_id", "lifetime_value", "ltv_quartile", "plan_quintile")


@register("W4_lag_lead", """
SELECT user_id, event_id, ts,
       lag(ts) OVER w AS prev_ts,
       date_diff('second', lag(ts) OVER w, ts) AS seconds_since_prev,
       lead(event_type) OVER w AS next_event_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w4(t: Tables):
    """lag / lead over blocks of rows with their neighbours' edges: no per-user window task."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    order = [F.col("ts"), F.col("event_id")]
    both = shifted(e, order, ["user_id"], [(["ts"], 1, "prev_"), (["event_type"], -1, "next_")])
    return both.select(
        "user_id", "event_id", "ts", F.col("prev_ts"),
        boundary_diff("second", F.col("prev_ts"), F.col("ts")).alias("seconds_since_prev"), "next_event_type")


@register("W5_running_sum", """
SELECT user_id, event_id, ts,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_value
FROM events
""")
def w5(t: Tables):
    """Running sum per user, skew-safe (range-split groups + partition offsets)."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    r = ranked(e, [F.col("ts"), F.col("event_id")], ["user_id"], running=[("sum", "value", "_rs")])
    return r.select("user_id", "event_id", "ts", F.round("_rs", 6).alias("running_value"))


@register("W6_moving_average", """
SELECT user_id, event_id, ts,
       round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_avg_7
FROM events
""")
def w6(t: Tables):
    """7-row moving average per user, skew-safe (blocks of rows with a halo)."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    m = moving_frame(e, [F.col("ts"), F.col("event_id")], ["user_id"], "value", -6, 0, ["event_id", "ts"], "_ma")
    return m.select("user_id", "event_id", "ts", F.round("_ma", 6).alias("moving_avg_7"))


@register("W7_trailing_excluding_current", """
SELECT user_id, event_id, value, rolling_avg FROM (
  SELECT user_id, event_id, value,
         round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS rolling_avg
  FROM events)
WHERE rolling_avg > 0 AND value > rolling_avg * 3
""")
def w7(t: Tables):
    """Trailing 5-row average excluding the current row, skew-safe."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    m = moving_frame(e, [F.col("ts"), F.col("event_id")], ["user_id"], "value", -5, -1, ["event_id"], "_ra")
    r = m.select("user_id", "event_id", "value", F.round("_ra", 6).alias("rolling_avg"))
    return r.where((F.col("rolling_avg") > 0) & (F.col("value") > F.col("rolling_avg") * 3))


@register("W8_first_last_value", """
SELECT user_id, event_id,
       first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_type,
       last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type
FROM events
""")
def w8(t: Tables):
    """first/last value over the full frame = min_by/max_by per user joined
    back: map-side combined, no per-user window buffer; the join deals a hot
    user's rows over all tasks."""
    e = t.events
    k = F.struct("ts", "event_id")
    ends = e.groupBy("user_id").agg(F.min_by("event_type", k).alias("first_type"),
                                    F.max_by("event_type", k).alias("last_type"))
    return skew_join(e.select("user_id", "event_id"), ends, ["user_id"], null_safe=True)


@register("W9_partition_aggregate", """
SELECT user_id, event_id, value, round(avg(value) OVER (PARTITION BY user_id), 6) AS user_avg,
       round(value - round(avg(value) OVER (PARTITION BY user_id), 6), 6) AS diff_from_avg,
       round(value * 100.0 / sum(value) OVER (PARTITION BY user_id), 6) AS share_pct
FROM events
""")
def w9(t: Tables):
    """Per-user average / share.  Written as aggregate + join rather than an
    unordered window, so the per-user totals are map-side combined and a
    hot user never has to sit in one window buffer."""
    e = t.events.select("user_id", "event_id", "value")
    agg = e.groupBy("user_id").agg(F.avg("value").alias("_avg"), F.sum("value").alias("_sum"))
    return skew_join(e, agg, ["user_id"], null_safe=True).select(
        "user_id", "event_id", "value", F.round("_avg", 6).alias("user_avg"),
        F.round(F.col("value") - F.round("_avg", 6), 6).alias("diff_from_avg"),
        F.round(pct("value", "_sum"), 6).alias("share_pct"))


@register("W10_share_of_total", """
SELECT n_name, round(total, 2) AS total_bal, round(total * 100.0 / sum(total) OVER (), 6) AS pct_of_total,
       rank() OVER (ORDER BY total DESC) AS nation_rank
FROM (SELECT n.n_name, sum(c.c_acctbal) AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1)
""")
def w10(t: Tables):
    """SUM(x) OVER () as a one-row total cross-joined back (no single-task window)."""
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    per = c.groupBy("n_name").agg(F.sum("c_acctbal").alias("total"))
    grand = F.broadcast(per.agg(F.sum("total").alias("_grand")))
    r = ranked(per.crossJoin(grand), [F.col("total").desc()], rank="nation_rank")
    return r.select("n_name", F.round("total", 2).alias("total_bal"),
                    F.round(pct("total", "_grand"), 6).alias("pct_of_total"), "nation_rank")


@register("W11_named_window", """
SELECT user_id, event_id, count(*) OVER w AS n_so_far, min(value) OVER w AS min_so_far, max(value) OVER w AS max_so_far
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def w11(t: Tables):
    """Three aggregates over one named running frame (count, min, max),
    computed skew-safe in a single ranked pass."""
    e = t.events.select("user_id", "event_id", "ts", "value")
    r = ranked(e, [F.col("ts"), F.col("event_id")], ["user_id"],
               running=[("count", "value", "n_so_far"), ("min", "value", "min_so_far"), ("max", "value", "max_so_far")])
    return r.select("user_id", "event_id", "n_so_far", "min_so_far", "max_so_far")


@register("W12_top_n_per_group", """
SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
WHERE rn <= 3
""")
def w12(t: Tables):
    r = top_n_per_group(t.customer, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return r.select("c_nationkey", "c_custkey", "c_name", "c_acctbal")


def _monthly_orders(t: Tables):
    return t.orders.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(F.count("*").alias("n"))


@register("W13_period_growth", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, n, lag(n) OVER (ORDER BY month) AS prev_n,
       round((n - lag(n) OVER (ORDER BY month)) * 100.0 / lag(n) OVER (ORDER BY month), 2) AS growth_pct
FROM m
""")
def w13(t: Tables):
    """Aggregate first (one row per month), then a global lag over the tiny series."""
    m = _monthly_orders(t)
    prev = F.lag("n").over(Window.orderBy("month"))
    return m.select("month", "n", prev.alias("prev_n"), growth_pct(F.col("n"), prev).alias("growth_pct"))


def _daily_purchases(t: Tables):
    return t.events.where(F.col("event_type") == "purchase").groupBy(F.to_date("ts").alias("day")) \
        .agg(F.count("*").alias("n"))


@register("W14_spike_flag", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
     a AS (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg_3d,
                  avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS avg_7d FROM d)
SELECT day, n, round(avg_3d, 6) AS avg_3d, round(avg_7d, 6) AS avg_7d,
       CASE WHEN avg_7d > 0 AND avg_3d > avg_7d * 1.05 THEN 'spike' ELSE 'normal' END AS trend_flag
FROM a
""")
def w14(t: Tables):
    d = _daily_purchases(t)
    a3 = F.avg("n").over(frame([], ["day"], -2, 0))
    a7 = F.avg("n").over(frame([], ["day"], -6, 0))
    a = d.select("day", "n", a3.alias("a3"), a7.alias("a7"))
    return a.select("day", "n", F.round("a3", 6).alias("avg_3d"), F.round("a7", 6).alias("avg_7d"),
                    F.when((F.col("a7") > 0) & (F.col("a3") > F.col("a7") * 1.05), "spike").otherwise("normal")
                    .alias("trend_flag"))


@register("W15_cumulative_ratio", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n,
                  count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT month, round(f * 100.0 / n, 2) AS monthly_rate,
       round(sum(f) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100.0 /
             sum(n) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative_rate
FROM m
""")
def w15(t: Tables):
    m = t.orders.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    w = running([], ["month"])
    return m.select("month", F.round(pct("f", "n"), 2).alias("monthly_rate"),
                    F.round(pct(F.sum("f").over(w), F.sum("n").over(w)), 6).alias("cumulative_rate"))


@register("W16_window_over_aggregate", """
SELECT o_orderpriority, year(o_orderdate) AS yr, count(*) AS n,
       lag(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS prev_year_n
FROM orders GROUP BY o_orderpriority, yr
""")
def w16(t: Tables):
    g = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return g.withColumn("prev_year_n", F.lag("n").over(Window.partitionBy("o_orderpriority").orderBy("yr")))


@register("W17_min_max_normalise", """
SELECT user_id, event_id, value, min(value) OVER w AS min_v, max(value) OVER w AS max_v,
       round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0
             ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS normalized_score
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def w17(t: Tables):
    """Min-max normalisation per user; min/max are a per-user aggregate
    joined back (map-side combined) rather than an unordered window."""
    e = t.events.select("user_id", "event_id", "value")
    mm = e.groupBy("user_id").agg(F.min("value").alias("min_v"), F.max("value").alias("max_v"))
    j = null_safe_join(e, mm, ["user_id"])
    norm = F.when(F.col("max_v") == F.col("min_v"), F.lit(0.0)).otherwise(
        (F.col("value") - F.col("min_v")) / (F.col("max_v") - F.col("min_v")))
    return j.select("user_id", "event_id", "value", "min_v", "max_v", F.round(norm, 6).alias("normalized_score"))


@register("W18_window_count_arg_max", """
WITH x AS (SELECT e.product_id, e.event_type, p.p_type,
                  count(*) OVER (PARTITION BY e.event_type, e.product_id) AS type_cnt
           FROM event_facts e JOIN part p ON e.product_id = p.p_partkey)
SELECT p_type, count(*) AS n_events, arg_max(event_type, (type_cnt, event_type)) AS most_common_type FROM x GROUP BY p_type
""", bind=("event_facts",))
def w18(t: Tables):
    """The per-(type, product) count is an aggregate joined back (map-side
    combined) instead of an unordered window; then max_by picks the winner."""
    e = t.event_facts.select("product_id", "event_type")
    cnt = e.groupBy("event_type", "product_id").agg(F.count("*").alias("type_cnt"))
    x = e.join(cnt, ["event_type", "product_id"]).join(t.part.select("p_partkey", "p_type"),
                                                        F.col("product_id") == F.col("p_partkey"))
    return x.groupBy("p_type").agg(F.count("*").alias("n_events"),
                                   F.max_by("event_type", F.struct("type_cnt", "event_type")).alias("most_common_type"))


# a tenth of the events has no user: NULL is one (large) group of a window
_NULL_USERS = "ev AS (SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, event_id, event_type, ts, value FROM events)"


def _null_users(t: Tables):
    return t.events.select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), "event_id", "event_type", "ts", "value")


@register("W19_null_group_ranking", f"""
WITH {_NULL_USERS}
SELECT user_id, event_id, row_number() OVER w AS rn, lag(event_id) OVER w AS prev_id, lead(event_type) OVER w AS next_event_type,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_value
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def w19(t: Tables):
    """Positions, neighbours and running sums where events without a user are one group."""
    e, order = _null_users(t), [F.col("ts"), F.col("event_id")]
    r = ranked(e, order, ["user_id"], row_number="rn", running=[("sum", "value", "_rs")])
    s = shifted(r.drop("value"), order, ["user_id"], [(["event_id"], 1, "prev_"), (["event_type"], -1, "next_")])
    return s.select("user_id", "event_id", "rn", F.col("prev_event_id").alias("prev_id"), "next_event_type", F.round("_rs", 6).alias("running_value"))


@register("W20_null_group_aggregates", f"""
WITH {_NULL_USERS}
SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS user_avg, max(value) OVER (PARTITION BY user_id) AS max_v,
       first_value(event_type) OVER w AS first_type,
       round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_avg_7
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def w20(t: Tables):
    """Partition aggregates and moving averages where events without a user are one group."""
    e = _null_users(t)
    agg = e.groupBy("user_id").agg(F.avg("value").alias("_avg"), F.max("value").alias("max_v"),
                                   F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    m = moving_frame(e, [F.col("ts"), F.col("event_id")], ["user_id"], "value", -6, 0, ["event_id"], "_ma")
    return null_safe_join(m, agg, ["user_id"]).select("user_id", "event_id", F.round("_avg", 6).alias("user_avg"), "max_v", "first_type",
                                                      F.round("_ma", 6).alias("moving_avg_7"))


@register("W21_null_group_quantiles", f"""
WITH {_NULL_USERS}
SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90_value FROM ev GROUP BY user_id
""")
def w21(t: Tables):
    """Exact quantiles per user, events without a user being a group."""
    q = exact_quantiles(_null_users(t), "value", [0.5, 0.9], ["user_id"], ["m", "p"])
    return q.select("user_id", F.round("m", 6).alias("median_value"), F.round("p", 6).alias("p90_value"))

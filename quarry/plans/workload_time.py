"""R ops (time-series recipes) and X11 (ordered event sequences)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import boundary_diff, pct, ratio, start_of_month, start_of_week
from quarry.operators.distincts import distinct_if
from quarry.operators.joins import semi_join_top_k
from quarry.operators.ranking import ranked, shifted
from quarry.operators.timeseries import calendar_counts, session_table, sessionize
from quarry.operators.windows import growth_pct, top_n_per_group
from quarry.plans.registry import register
from quarry.sources.tables import Tables


@register("R1_calendar_buckets", """
SELECT 'minute' AS kind, strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM events GROUP BY 1, 2
UNION ALL SELECT 'hour_of_day', CAST(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'iso_weekday', CAST(isodow(ts) AS VARCHAR), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'week', strftime(date_trunc('week', ts), '%Y-%m-%d'), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d'), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'month_num', CAST(month(ts) AS VARCHAR), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'year', CAST(year(ts) AS VARCHAR), count(*) FROM events GROUP BY 1, 2
UNION ALL SELECT 'yyyymm', strftime(ts, '%Y%m'), count(*) FROM events GROUP BY 1, 2
""")
def r1(t: Tables):
    return calendar_counts(t.events, "ts")


@register("R2_rate_per_bucket", """
SELECT date_trunc('week', ts)::DATE AS week, count(*) AS n,
       round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*), 6) AS purchase_rate
FROM events GROUP BY week
""")
def r2(t: Tables):
    e = t.events
    return e.groupBy(start_of_week("ts").alias("week")).agg(
        F.count("*").alias("n"), F.round(pct(F.count_if(F.col("event_type") == "purchase"), F.count("*")), 6)
        .alias("purchase_rate"))


@register("R3_month_year_over_year", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, n, lag(n, 1) OVER (ORDER BY month) AS prev_month,
       round((n - lag(n, 1) OVER (ORDER BY month)) * 100.0 / lag(n, 1) OVER (ORDER BY month), 2) AS mom_pct,
       lag(n, 12) OVER (ORDER BY month) AS prev_year,
       round((n - lag(n, 12) OVER (ORDER BY month)) * 100.0 / lag(n, 12) OVER (ORDER BY month), 2) AS yoy_pct
FROM m
""")
def r3(t: Tables):
    m = t.orders.groupBy(start_of_month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    w = Window.orderBy("month")
    p1, p12 = F.lag("n", 1).over(w), F.lag("n", 12).over(w)
    return m.select("month", "n", p1.alias("prev_month"), growth_pct(F.col("n"), p1).alias("mom_pct"),
                    p12.alias("prev_year"), growth_pct(F.col("n"), p12).alias("yoy_pct"))


def _cohorts(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.min(start_of_month("o_orderdate")).alias("cohort_month"))


@register("R4_cohort_retention", """
WITH cohorts AS (SELECT o_custkey, min(date_trunc('month', o_orderdate))::DATE AS cohort_month FROM orders GROUP BY 1),
     act AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS activity_month FROM orders)
SELECT c.cohort_month, count(DISTINCT c.o_custkey) AS cohort_size, count(DISTINCT a.o_custkey) AS retained_users,
       round(count(DISTINCT a.o_custkey) * 100.0 / count(DISTINCT c.o_custkey), 2) AS retention_pct
FROM cohorts c LEFT JOIN act a ON a.o_custkey = c.o_custkey AND a.activity_month = c.cohort_month + INTERVAL 1 MONTH
GROUP BY c.cohort_month
""")
def r4(t: Tables):
    c = _cohorts(t)
    act = t.orders.select(F.col("o_custkey").alias("a_cust"), start_of_month("o_orderdate").alias("am")).distinct()
    j = c.join(act, (F.col("a_cust") == F.col("o_custkey")) & (F.col("am") == F.add_months("cohort_month", 1)), "left")
    # a cohort row is one customer and an activity row one customer's month, so rows count customers
    g = j.groupBy("cohort_month").agg(F.count("o_custkey").alias("cohort_size"), F.count("a_cust").alias("retained_users"))
    return g.withColumn("retention_pct", F.round(pct("retained_users", "cohort_size"), 2))


@register("R5_cohort_windows", """
WITH first_o AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_day FROM orders GROUP BY 1)
SELECT date_trunc('month', f.first_day)::DATE AS cohort_month, count(DISTINCT f.o_custkey) AS cohort_size,
       round(count(*) FILTER (WHERE date_diff('day', f.first_day, o.o_orderdate::DATE) BETWEEN 0 AND 6) / count(DISTINCT f.o_custkey), 6) AS avg_orders_7d,
       round(count(*) FILTER (WHERE date_diff('day', f.first_day, o.o_orderdate::DATE) BETWEEN 0 AND 29) / count(DISTINCT f.o_custkey), 6) AS avg_orders_30d
FROM first_o f LEFT JOIN orders o ON o.o_custkey = f.o_custkey
GROUP BY 1
""")
def r5(t: Tables):
    first = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"))
    o = t.orders.select(F.col("o_custkey").alias("oc"), F.to_date("o_orderdate").alias("od"))
    j = first.join(o, F.col("oc") == F.col("o_custkey"), "left")
    dd = F.datediff("od", "first_day")
    size = F.countDistinct("o_custkey")
    return j.groupBy(F.trunc("first_day", "MM").alias("cohort_month")).agg(
        size.alias("cohort_size"),
        F.round(ratio(F.count_if(dd.between(0, 6)), size), 6).alias("avg_orders_7d"),
        F.round(ratio(F.count_if(dd.between(0, 29)), size), 6).alias("avg_orders_30d"))


@register("R6_time_to_first_purchase", """
SELECT round(avg(date_diff('hour', first_event, first_purchase)), 6) AS avg_hours_to_purchase, count(*) AS buyers
FROM (SELECT user_id, min(ts) AS first_event, min(ts) FILTER (WHERE event_type = 'purchase') AS first_purchase
      FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING first_purchase IS NOT NULL)
""")
def r6(t: Tables):
    per = (t.events.where(F.col("user_id").isNotNull()).groupBy("user_id")
           .agg(F.min("ts").alias("first_event"),
                F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_purchase"))
           .where(F.col("first_purchase").isNotNull()))
    return per.agg(F.round(F.avg(boundary_diff("hour", "first_event", "first_purchase")), 6)
                   .alias("avg_hours_to_purchase"), F.count("*").alias("buyers"))


@register("R7_days_active", """
SELECT c.c_custkey, c.c_name, min(e.ts)::DATE AS first_day, max(e.ts)::DATE AS last_day,
       date_diff('day', min(e.ts)::DATE, max(e.ts)::DATE) AS days_active
FROM customer c JOIN events e ON c.c_custkey = e.user_id
GROUP BY c.c_custkey, c.c_name ORDER BY days_active DESC, c.c_custkey LIMIT 20
""")
def r7(t: Tables):
    per = t.events.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first_day"),
                                          F.to_date(F.max("ts")).alias("last_day"))
    j = per.join(t.customer, per.user_id == t.customer.c_custkey).select(
        "c_custkey", "c_name", "first_day", "last_day", F.datediff("last_day", "first_day").alias("days_active"))
    return j.orderBy(F.col("days_active").desc(), "c_custkey").limit(20)


@register("R8_outlier_buckets", """
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
     s AS (SELECT avg(n) AS mu, stddev_pop(n) AS sigma FROM h)
SELECT h.hour, h.n, round(s.mu, 6) AS mean_n, round(s.sigma, 6) AS std_n
FROM h CROSS JOIN s WHERE h.n > s.mu + 2 * s.sigma
""")
def r8(t: Tables):
    h = t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    s = F.broadcast(h.agg(F.avg("n").alias("mu"), F.stddev_pop("n").alias("sigma")))  # one row
    return (h.crossJoin(s).where(F.col("n") > F.col("mu") + 2 * F.col("sigma"))
            .select("hour", "n", F.round("mu", 6).alias("mean_n"), F.round("sigma", 6).alias("std_n")))


@register("R9_deviation_top_groups", """
WITH top_nations AS (SELECT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
                     GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5),
     m AS (SELECT c_nationkey, date_trunc('year', o_orderdate)::DATE AS yr, count(*) AS n
           FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE c_nationkey IN (SELECT c_nationkey FROM top_nations) GROUP BY 1, 2)
SELECT c_nationkey, yr, n, round(avg(n) OVER (PARTITION BY c_nationkey), 6) AS nation_avg,
       round((n - avg(n) OVER (PARTITION BY c_nationkey)) * 100.0 / avg(n) OVER (PARTITION BY c_nationkey), 2) AS deviation_pct
FROM m
""")
def r9(t: Tables):
    oc = t.orders.select("o_custkey", "o_orderdate").join(t.customer.select("c_custkey", "c_nationkey"),
                                                          F.col("o_custkey") == F.col("c_custkey"))
    top = semi_join_top_k(oc, "c_nationkey", 5)
    m = top.groupBy("c_nationkey", F.trunc(F.to_date("o_orderdate"), "YEAR").alias("yr")).agg(F.count("*").alias("n"))
    a = F.avg("n").over(Window.partitionBy("c_nationkey"))  # <= #years rows per nation
    return m.select("c_nationkey", "yr", "n", F.round(a, 6).alias("nation_avg"),
                    growth_pct(F.col("n"), a).alias("deviation_pct"))


@register("R10_largest_rise_per_year", """
WITH m AS (SELECT year(o_orderdate) AS yr, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1, 2),
     d AS (SELECT yr, month, n - lag(n) OVER (PARTITION BY yr ORDER BY month) AS increase FROM m),
     r AS (SELECT yr, month, increase, row_number() OVER (PARTITION BY yr ORDER BY increase DESC, month) AS rn FROM d WHERE increase IS NOT NULL)
SELECT yr, month, increase FROM r WHERE rn = 1
""")
def r10(t: Tables):
    m = t.orders.groupBy(F.year("o_orderdate").alias("yr"), start_of_month("o_orderdate").alias("month")) \
        .agg(F.count("*").alias("n"))
    d = m.select("yr", "month", (F.col("n") - F.lag("n").over(Window.partitionBy("yr").orderBy("month")))
                 .alias("increase")).where(F.col("increase").isNotNull())
    return top_n_per_group(d, ["yr"], [F.col("increase").desc(), F.col("month")], 1).select("yr", "month", "increase")


@register("R11_items_per_active_day", """
SELECT o_orderpriority, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS active_days,
       round(count(*) / (date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1), 6) AS avg_daily_rate
FROM orders GROUP BY o_orderpriority HAVING active_days > 1
""")
def r11(t: Tables):
    g = t.orders.groupBy("o_orderpriority").agg(
        (F.datediff(F.to_date(F.max("o_orderdate")), F.to_date(F.min("o_orderdate"))) + 1).alias("active_days"),
        F.count("*").alias("_n"))
    return g.where(F.col("active_days") > 1).select("o_orderpriority", "active_days",
                                                    F.round(ratio("_n", "active_days"), 6).alias("avg_daily_rate"))


@register("R12_followed_by", """
SELECT user_id, event_id, ts FROM (
  SELECT user_id, event_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE event_type = 'view' AND nxt = 'purchase'
""")
def r12(t: Tables):
    """A view immediately followed (per user) by a purchase; the next event
    comes from a lead over skew-safe blocks of rows."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    nxt = shifted(e, [F.col("ts"), F.col("event_id")], ["user_id"], [(["event_type"], -1, "next_")])
    return (nxt.where((F.col("event_type") == "view") & (F.col("next_event_type") == "purchase"))
            .select("user_id", "event_id", "ts"))


@register("R13_funnel_by_country", """
SELECT u.country, count(DISTINCT e.user_id) FILTER (WHERE e.event_type = 'view') AS visitors,
       count(DISTINCT e.user_id) FILTER (WHERE e.event_type = 'click') AS clickers,
       count(DISTINCT e.user_id) FILTER (WHERE e.event_type = 'signup') AS signups,
       count(DISTINCT e.user_id) FILTER (WHERE e.event_type = 'purchase') AS purchasers
FROM events e JOIN users u ON e.user_id = u.user_id WHERE e.user_id IS NOT NULL
GROUP BY u.country
""", bind=("users",))
def r13(t: Tables):
    e = t.events.where(F.col("user_id").isNotNull()).select("user_id", "event_type")
    j = e.join(t.users.select("user_id", "country"), "user_id")
    kind = F.col("event_type")
    return distinct_if(j, ["country"], "user_id", {"visitors": kind == "view", "clickers": kind == "click", "signups": kind == "signup", "purchasers": kind == "purchase"})


_SESSIONS_ORACLE = """
g AS (SELECT user_id, event_id, ts, event_type,
             CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                    OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000
                  THEN 1 ELSE 0 END AS st FROM events),
s AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM g)"""


@register("R14_sessionize", f"""
WITH {_SESSIONS_ORACLE}
SELECT user_id, session_no, min(ts) AS start_time, max(ts) AS end_time,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS duration_seconds, count(*) AS event_count,
       arg_min(event_type, (ts, event_id)) AS entry_type, arg_max(event_type, (ts, event_id)) AS exit_type,
       max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS is_converted
FROM s GROUP BY user_id, session_no
""")
def r14(t: Tables):
    return session_table(t.events, gap_seconds=3600)


@register("X11_event_sequence", f"""
WITH {_SESSIONS_ORACLE},
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS rn FROM s)
SELECT user_id, session_no, (rn - 1) // 1000 AS chunk,
       string_agg(event_type, '>' ORDER BY ts, event_id) AS event_sequence, count(*) AS event_count
FROM q GROUP BY 1, 2, 3
""")
def x11(t: Tables, chunk_size: int = 1000):
    """Ordered event sequence per session (groupArray over sorted rows).
    Order comes from a sort key carried with each value, never from input
    order.  A session of any length comes as chunks numbered from 0, event
    ``i`` of it in chunk ``i // chunk_size``, so that no single array grows
    with a hot user's history."""
    s = sessionize(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id", 3600)
    q = ranked(s, [F.col("ts"), F.col("event_id")], ["user_id", "session_no"], row_number="_rn")
    q = q.withColumn("chunk", F.floor((F.col("_rn") - 1) / chunk_size).cast("bigint"))
    seq = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return q.groupBy("user_id", "session_no", "chunk").agg(
        F.array_join(F.transform(seq, lambda x: x["event_type"]), ">").alias("event_sequence"),
        F.count("*").alias("event_count"))

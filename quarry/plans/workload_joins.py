"""J ops: equi, outer, star, semi/anti, scalar and cross joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import in_years
from quarry.operators.joins import anti_join_not_in, semi_join_top_k, skew_join
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.sinks import write_calendar, write_month_layout
from quarry.sources.tables import Tables


def star_flight4(t: Tables, region: str = "AMERICA", brands=("Brand#1", "Brand#2")):
    """Profit by order year and customer nation; customer and supplier in
    one region, part from two brands (SSB flight 4 on the driver tables)."""
    reg = F.broadcast(t.region.where(F.col("r_name") == region).select("r_regionkey"))  # <=5 rows
    nat = F.broadcast(t.nation.join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
                      .select("n_nationkey", "n_name"))                                  # <=25 rows
    cust = (t.customer.select("c_custkey", "c_nationkey")
            .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_name").alias("c_nation")))
    supp = (t.supplier.select("s_suppkey", "s_nationkey")
            .join(nat.select(F.col("n_nationkey").alias("sn")), F.col("s_nationkey") == F.col("sn"), "left_semi")
            .select("s_suppkey"))
    part = t.part.where(F.col("p_brand").isin(*brands)).select("p_partkey")
    orders = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
              .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    facts = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
             .join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi"))
    profit = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice") * F.col("l_tax")
    return (facts.groupBy(F.year("o_orderdate").alias("d_year"), "c_nation")
            .agg(F.round(F.sum(profit), 2).alias("profit")))


register("J5_star_flight4", oracle="""
SELECT year(o.o_orderdate) AS d_year, cn.n_name AS c_nation,
       round(sum(l.l_extendedprice * (1 - l.l_discount) - l.l_extendedprice * l.l_tax), 2) AS profit
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation sn ON s.s_nationkey = sn.n_nationkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND (p.p_brand = 'Brand#1' OR p.p_brand = 'Brand#2')
GROUP BY d_year, c_nation
""")(star_flight4)


@register("J1_inner_equi", """
SELECT o.o_orderkey, c.c_name, c.c_mktsegment, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F'
""")
def j1(t: Tables):
    o = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return skew_join(o, c, ["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@register("J2_left_outer_count", """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS order_count
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND year(o.o_orderdate) = 1997
GROUP BY c.c_custkey, c.c_name
""")
def j2(t: Tables):
    """Customers with their 1997 order count, zero kept for non-buyers.
    The order side is pre-aggregated per customer before the join, so the
    join moves one row per customer rather than every order."""
    per = (t.orders.where(in_years("o_orderdate", 1997, 1997)).groupBy("o_custkey")
           .agg(F.count("o_orderkey").alias("order_count")))
    c = t.customer
    return (c.join(per, c.c_custkey == per.o_custkey, "left")
            .select("c_custkey", "c_name", F.coalesce("order_count", F.lit(0)).alias("order_count")))


@register("J3_chained_left_default", """
SELECT coalesce(n.n_name, 'anonymous') AS user_nation, count(*) AS event_count,
       count(*) FILTER (WHERE e.event_type = 'purchase') AS purchase_count
FROM events e
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) c ON e.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY user_nation
""")
def j3(t: Tables):
    c = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows by definition
    e = t.events.select("user_id", "event_type")
    j = e.join(c, e.user_id == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("anonymous")).alias("user_nation")).agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "purchase").alias("purchase_count"))


@register("J4_computed_key_join", """
SELECT p.p_type, e.event_type, count(*) AS n_events, round(sum(e.value), 2) AS total_value
FROM event_facts e JOIN part p ON e.product_id = p.p_partkey
WHERE e.prop_k != ''
GROUP BY p.p_type, e.event_type
""", bind=("event_facts",))
def j4(t: Tables):
    """Join on a key parsed out of a JSON property (toUInt64OrZero semantics)."""
    e = t.event_facts.where(F.col("prop_k") != "")
    p = t.part.select("p_partkey", "p_type")
    return (e.join(p, e.product_id == p.p_partkey).groupBy("p_type", "event_type")
            .agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value")))


@register("J6_three_way", """
SELECT c.c_mktsegment, count(*) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
WHERE l.l_returnflag = 'R'
GROUP BY c.c_mktsegment
""")
def j6(t: Tables):
    li = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_extendedprice", "l_discount")
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_mktsegment")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"),
                                         F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
                                         .alias("revenue"))


@register("J7_join_own_aggregate", """
SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, round(a.avg_bal, 6) AS nation_avg
FROM customer c JOIN (SELECT c_nationkey, avg(c_acctbal) AS avg_bal FROM customer GROUP BY c_nationkey) a
  ON c.c_nationkey = a.c_nationkey
WHERE c.c_acctbal > a.avg_bal
""")
def j7(t: Tables):
    c = t.customer
    a = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("avg_bal"))
    return (c.join(a, "c_nationkey").where(F.col("c_acctbal") > F.col("avg_bal"))
            .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.round("avg_bal", 6).alias("nation_avg")))


@register("J8_using_join", """
SELECT hour_of_day, purchases, round(avg_view_value, 6) AS avg_view_value FROM
 (SELECT hour(ts) AS hour_of_day, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY 1) p
 JOIN (SELECT hour(ts) AS hour_of_day, avg(value) AS avg_view_value FROM events WHERE event_type = 'view' GROUP BY 1) v
 USING (hour_of_day)
""")
def j8(t: Tables):
    e = t.events
    p = e.where(F.col("event_type") == "purchase").groupBy(F.hour("ts").alias("hour_of_day")) \
        .agg(F.count("*").alias("purchases"))
    v = e.where(F.col("event_type") == "view").groupBy(F.hour("ts").alias("hour_of_day")) \
        .agg(F.round(F.avg("value"), 6).alias("avg_view_value"))
    return p.join(v, "hour_of_day")


@register("J9_anti_join", """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS order_count
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
WHERE c.c_custkey NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)
GROUP BY c.c_custkey, c.c_name
""")
def j9(t: Tables):
    buyers = t.events.where(F.col("event_type") == "purchase")
    c = anti_join_not_in(t.customer, buyers, "c_custkey", "user_id")
    per = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("order_count"))
    return c.join(per, c.c_custkey == per.o_custkey).select("c_custkey", "c_name", "order_count")


@register("J10_semi_join_top_k", """
WITH top_users AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5)
SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM top_users)
GROUP BY user_id, event_type
""")
def j10(t: Tables):
    kept = semi_join_top_k(t.events, "user_id", 5)
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("J11_cross_join_stats", """
WITH monthly AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1),
     stats AS (SELECT avg(total) AS mu, stddev_pop(total) AS sigma FROM monthly)
SELECT m.month, round(m.total, 2) AS total, round((m.total - s.mu) / s.sigma, 6) AS z_score
FROM monthly m CROSS JOIN stats s
""")
def j11(t: Tables):
    monthly = t.orders.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")) \
        .agg(F.sum("o_totalprice").alias("total"))
    stats = F.broadcast(monthly.agg(F.avg("total").alias("mu"), F.stddev_pop("total").alias("sigma")))  # one row
    return monthly.crossJoin(stats).select("month", F.round("total", 2).alias("total"),
                                           F.round((F.col("total") - F.col("mu")) / F.col("sigma"), 6).alias("z_score"))


@register("J12_scalar_subquery", """
WITH per AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, n_orders FROM per WHERE n_orders > (SELECT avg(n_orders) FROM per)
""")
def j12(t: Tables):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    avg = F.broadcast(per.agg(F.avg("n_orders").alias("_avg")))  # one row
    return per.crossJoin(avg).where(F.col("n_orders") > F.col("_avg")).select("o_custkey", "n_orders")


@register("J13_month_offset_join", """
WITH first_m AS (SELECT o_custkey, min(date_trunc('month', o_orderdate))::DATE AS cohort_month FROM orders GROUP BY 1),
     act AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS activity_month FROM orders)
SELECT f.cohort_month, count(DISTINCT f.o_custkey) AS cohort_size, count(DISTINCT a.o_custkey) AS active_next_month
FROM first_m f LEFT JOIN act a ON a.o_custkey = f.o_custkey AND a.activity_month = f.cohort_month + INTERVAL 1 MONTH
GROUP BY f.cohort_month
""")
def j13(t: Tables):
    m = F.trunc(F.to_date("o_orderdate"), "MM")
    first = t.orders.groupBy("o_custkey").agg(F.min(m).alias("cohort_month"))
    act = t.orders.select(F.col("o_custkey").alias("a_cust"), m.alias("activity_month")).distinct()
    j = first.join(act, (F.col("a_cust") == F.col("o_custkey"))
                   & (F.col("activity_month") == F.add_months("cohort_month", 1)), "left")
    # one row a customer on both sides, so rows count customers
    return j.groupBy("cohort_month").agg(F.count("o_custkey").alias("cohort_size"), F.count("a_cust").alias("active_next_month"))


@register("J14_conditional_left_join", """
SELECT e.event_type, count(*) AS n_events, count(p.p_partkey) AS matched_products
FROM event_facts e LEFT JOIN part p ON e.event_type = 'purchase' AND e.product_id = p.p_partkey
GROUP BY e.event_type
""", bind=("event_facts",))
def j14(t: Tables):
    e = t.event_facts.select("event_type", "product_id")
    p = t.part.select("p_partkey")
    j = e.join(p, (e.event_type == "purchase") & (e.product_id == p.p_partkey), "left")
    return j.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count("p_partkey").alias("matched_products"))


def _region_nations(t: Tables, region: str):
    """Nations of one region: at most 25 rows by definition, broadcast."""
    reg = t.region.where(F.col("r_name") == region).select("r_regionkey")
    return F.broadcast(t.nation.join(F.broadcast(reg), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
                       .select("n_nationkey", "n_name"))


@register("J5_star_flight1", """
SELECT round(sum(l.l_extendedprice * l.l_discount), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE year(o.o_orderdate) = 1996 AND l.l_discount BETWEEN 0.01 AND 0.03 AND l.l_quantity < 25
""")
def star_flight1(t: Tables):
    """SSB flight 1: one fact-dimension join, filters on both sides, one sum."""
    li = t.lineitem.where(F.col("l_discount").between(0.01, 0.03) & (F.col("l_quantity") < 25)) \
        .select("l_orderkey", "l_extendedprice", "l_discount")
    o = t.orders.where(in_years("o_orderdate", 1996, 1996)).select("o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").agg(
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@register("J5_pruned_star", """
SELECT year(o_orderdate) AS d_year, quarter(o_orderdate) AS d_quarter, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) IN (1, 2) GROUP BY ALL
""")
def pruned_star(t: Tables):
    """Star join over facts in the month layout: the filter is on a calendar
    dimension, and the months it leaves prune the fact's folders at run time
    (dynamic partition pruning), so only their files are opened."""
    facts, calendar = scratch_path(t.spark, "orders-by-month"), scratch_path(t.spark, "calendar")
    write_month_layout(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), facts, "o_orderdate", ["o_orderdate"])
    write_calendar(t.orders, calendar, "o_orderdate")
    months = t.spark.read.parquet(calendar).where((F.col("d_year") == 1996) & F.col("d_quarter").isin(1, 2))
    o = t.spark.read.parquet(facts).join(F.broadcast(months), F.col("ym") == F.col("d_month"))  # a row a month
    nation = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # 25 rows
    j = o.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("d_year", "d_quarter", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("J5_star_flight2", """
SELECT year(o.o_orderdate) AS d_year, p.p_brand, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE p.p_type = 'ECONOMY' AND r.r_name = 'AMERICA'
GROUP BY d_year, p.p_brand
""")
def star_flight2(t: Tables):
    """SSB flight 2: revenue by year and brand for one part type and one supplier region."""
    supp = t.supplier.select("s_suppkey", "s_nationkey").join(
        _region_nations(t, "AMERICA"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")
    part = t.part.where(F.col("p_type") == "ECONOMY").select("p_partkey", "p_brand")
    li = (t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
          .join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
          .join(part, F.col("l_partkey") == F.col("p_partkey")))
    j = li.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.year("o_orderdate").alias("d_year"), "p_brand").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register("J5_star_flight3", """
SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, year(o.o_orderdate) AS d_year,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
JOIN region sr ON sn.n_regionkey = sr.r_regionkey
WHERE cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND year(o.o_orderdate) BETWEEN 1996 AND 1999
GROUP BY c_nation, s_nation, d_year
""")
def star_flight3(t: Tables):
    """SSB flight 3: revenue by customer nation, supplier nation and year within one region."""
    nat = _region_nations(t, "ASIA")
    cust = t.customer.select("c_custkey", "c_nationkey").join(nat, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", F.col("n_name").alias("c_nation"))
    supp = t.supplier.select("s_suppkey", "s_nationkey").join(nat, F.col("s_nationkey") == F.col("n_nationkey")) \
        .select("s_suppkey", F.col("n_name").alias("s_nation"))
    o = (t.orders.where(in_years("o_orderdate", 1996, 1999)).select("o_orderkey", "o_custkey", "o_orderdate")
         .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("c_nation", "s_nation", F.year("o_orderdate").alias("d_year")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))

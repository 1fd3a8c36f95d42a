"""F (projection/filter), O (order/limit), U (set ops), X (arrays/maps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.relational import arr_str, multiset_diff_keys, top_k, ts_lit
from quarry.functions import in_years
from quarry.plans.registry import register
from quarry.sources.tables import Tables

# ---------------------------------------------------------------- F ops


@register("F1_projection", """
SELECT event_id, event_type AS kind, ts AS event_time, value AS duration_ms FROM events
""")
def f1(t: Tables):
    return t.events.select("event_id", F.col("event_type").alias("kind"), F.col("ts").alias("event_time"),
                           F.col("value").alias("duration_ms"))


@register("F2_equality_filter", """
SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' AND user_id != 7
""")
def f2(t: Tables):
    return t.events.where((F.col("event_type") == "click") & (F.col("user_id") != 7)) \
        .select("event_id", "user_id", "ts")


@register("F3_between", """
SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'
  AND o_totalprice BETWEEN 50000 AND 200000
  AND o_orderpriority BETWEEN '1-URGENT' AND '2-HIGH'
""")
def f3(t: Tables):
    o = t.orders
    return o.where(o.o_orderdate.between(ts_lit("1996-01-01"), ts_lit("1996-06-30"))
                   & o.o_totalprice.between(50000, 200000)
                   & o.o_orderpriority.between("1-URGENT", "2-HIGH")) \
        .select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")


@register("F4_in_list", """
SELECT user_id, name, plan, lifetime_value, country FROM users
WHERE plan IN ('BUILDING', 'MACHINERY') AND lifetime_value > 5000
""", bind=("users",))
def f4(t: Tables):
    u = t.users
    return u.where(u.plan.isin("BUILDING", "MACHINERY") & (u.lifetime_value > 5000)) \
        .select("user_id", "name", "plan", "lifetime_value", "country")


@register("F5_like", """
SELECT product_id, name, category, price FROM products
WHERE (name LIKE '%ring%' OR name LIKE 'blue%') AND price BETWEEN 900 AND 1500
""", bind=("products",))
def f5(t: Tables):
    p = t.products
    return p.where((p.name.like("%ring%") | p.name.startswith("blue")) & p.price.between(900, 1500)) \
        .select("product_id", "name", "category", "price")


@register("F6_null_tests", """
SELECT c.c_custkey, c.c_name, c.c_acctbal,
       json_extract_string('{"k": 1}', '$.missing') IS NULL AS no_extra
FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996) o ON c.c_custkey = o.o_custkey
WHERE o.o_custkey IS NULL AND c.c_name IS NOT NULL
""")
def f6(t: Tables):
    buyers = t.orders.where(in_years("o_orderdate", 1996, 1996)).select(F.col("o_custkey")).distinct()
    c = t.customer
    return (c.join(buyers, c.c_custkey == buyers.o_custkey, "left")
            .where(F.col("o_custkey").isNull() & F.col("c_name").isNotNull())
            .select("c_custkey", "c_name", "c_acctbal",
                    F.get_json_object(F.lit('{"k": 1}'), "$.missing").isNull().alias("no_extra")))


@register("F7_column_compare", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount = l_tax
""")
def f7(t: Tables):
    li = t.lineitem
    return li.where(li.l_discount == li.l_tax).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@register("F8_or_groups", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem
WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_linestatus = 'F'
  AND (l_quantity < 5 OR l_quantity > 45)
""")
def f8(t: Tables):
    li = t.lineitem
    return li.where(((li.l_returnflag == "R") | (li.l_returnflag == "A")) & (li.l_linestatus == "F")
                    & ((li.l_quantity < 5) | (li.l_quantity > 45))) \
        .select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


@register("F9_relative_time", """
SELECT event_id, user_id, event_type, ts FROM events
WHERE event_type = 'signup' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def f9(t: Tables, days: int = 7):
    """'Last N days' anchored on the data's own latest timestamp (never the
    wall clock); the one-row anchor is broadcast."""
    e = t.events
    anchor = F.broadcast(e.agg(F.max("ts").alias("as_of")))
    return (e.where(F.col("event_type") == "signup").crossJoin(anchor)
            .where(F.col("ts") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS"))
            .select("event_id", "user_id", "event_type", "ts"))


@register("F10_map_access", """
SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events
WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') IS NOT NULL
""")
def f10(t: Tables):
    m = F.from_json("props", "map<string,string>")
    return (t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", m.alias("m"))
            .where(F.map_contains_key("m", "k")).select("event_id", "user_id", F.col("m")["k"].alias("k")))


@register("F11_array_membership", """
SELECT product_id, name, len(tags) AS n_tags FROM products
WHERE list_contains(tags, 'ring') AND len(tags) >= 2
""", bind=("products",))
def f11(t: Tables):
    p = t.products
    return p.where(F.array_contains("tags", "ring") & (F.size("tags") >= 2)) \
        .select("product_id", "name", F.size("tags").alias("n_tags"))


@register("F12_distinct", """
SELECT DISTINCT user_id, event_type FROM events
""")
def f12(t: Tables):
    return t.events.select("user_id", "event_type").distinct()


@register("F13_conditional", """
SELECT CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS tier,
       count(*) AS n_orders,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS fulfilled_share
FROM orders GROUP BY tier
""")
def f13(t: Tables):
    o = t.orders
    tier = (F.when(o.o_totalprice > 300000, "high").when(o.o_totalprice > 100000, "medium").otherwise("low"))
    return o.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.round(F.avg(F.when(o.o_orderstatus == "F", 1.0).otherwise(0.0)), 6).alias("fulfilled_share"))


@register("F14_cte_chain", """
WITH buys AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id),
     heavy AS (SELECT user_id, n FROM buys WHERE n >= 15)
SELECT h.user_id, c.c_name, h.n AS purchases FROM heavy h JOIN customer c ON h.user_id = c.c_custkey
""")
def f14(t: Tables):
    buys = t.events.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = buys.where(F.col("n") >= 15)
    return heavy.join(t.customer, heavy.user_id == t.customer.c_custkey) \
        .select("user_id", "c_name", F.col("n").alias("purchases"))


# ---------------------------------------------------------------- O ops


@register("O1_order_multi_key", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderpriority, o_orderstatus ORDER BY o_orderpriority ASC, total DESC
""")
def o1(t: Tables):
    o = t.orders
    return (o.groupBy("o_orderpriority", "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
            .orderBy(F.col("o_orderpriority").asc(), F.col("total").desc()))


@register("O2_top_k", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10
""")
def o2(t: Tables):
    c = t.customer
    return top_k(c.select("c_custkey", "c_name", "c_acctbal"), 10, F.col("c_acctbal").desc(), F.col("c_custkey"))


@register("O3_order_by_expression", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY length(p_name) DESC, p_retailprice DESC, p_partkey LIMIT 25
""")
def o3(t: Tables):
    p = t.part
    return top_k(p.select("p_partkey", "p_name", "p_retailprice"), 25,
                 F.length("p_name").desc(), F.col("p_retailprice").desc(), F.col("p_partkey"))


# ---------------------------------------------------------------- U ops


@register("U1_union_all", """
SELECT user_id AS party_id, 'event' AS kind, ts AS at FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT o_custkey AS party_id, 'order' AS kind, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F'
""")
def u1(t: Tables):
    a = t.events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("party_id"), F.lit("event").alias("kind"), F.col("ts").alias("at"))
    b = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("party_id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"))
    return a.unionByName(b)


def _daily_counts(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("U2_multiset_containment", """
WITH gold AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
     pred AS (SELECT * FROM gold WHERE event_type != 'error'
              UNION ALL SELECT day, event_type, n + 1 FROM gold WHERE event_type = 'view')
SELECT count(*) AS missing_rows, count(*) = 0 AS contained FROM (SELECT * FROM gold EXCEPT ALL SELECT * FROM pred)
""")
def u2(t: Tables):
    gold = _daily_counts(t)
    pred = gold.where(F.col("event_type") != "error").unionByName(
        gold.where(F.col("event_type") == "view").withColumn("n", F.col("n") + 1))
    return gold.exceptAll(pred).agg(F.count(F.lit(1)).alias("missing_rows"),
                                    (F.count(F.lit(1)) == 0).alias("contained"))


@register("U3_multiset_equality", """
WITH gold AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
     pred AS (SELECT * FROM gold UNION ALL SELECT * FROM gold WHERE n > 70),
     ga AS (SELECT day, event_type, n, count(*) AS c FROM gold GROUP BY ALL),
     pa AS (SELECT day, event_type, n, count(*) AS c FROM pred GROUP BY ALL)
SELECT count(*) AS differing_keys, count(*) = 0 AS equal
FROM ga FULL JOIN pa ON ga.day = pa.day AND ga.event_type = pa.event_type AND ga.n = pa.n
WHERE coalesce(ga.c, 0) != coalesce(pa.c, 0)
""")
def u3(t: Tables):
    gold = _daily_counts(t)
    pred = gold.unionByName(gold.where(F.col("n") > 70))
    d = multiset_diff_keys(gold, pred)
    return d.agg(F.count(F.lit(1)).alias("differing_keys"), (F.count(F.lit(1)) == 0).alias("equal"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("U4_name_set_diff", """
WITH used AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey,
       array_to_string(list_sort(list_filter(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'],
                                             lambda x: NOT list_contains(s, x))), ',') AS missing,
       array_to_string(list_sort(list_intersect(s, ['1-URGENT','2-HIGH'])), ',') AS urgent_used
FROM used
""")
def u4(t: Tables):
    """Per customer: priorities never used (set difference with the full
    catalogue) and urgent ones used (intersection)."""
    allp = F.array(*[F.lit(p) for p in _PRIORITIES])
    s = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return s.select("o_custkey", arr_str(F.array_except(allp, "s")).alias("missing"),
                    arr_str(F.array_intersect("s", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("urgent_used"))


# ---------------------------------------------------------------- X ops

_PREFS_ORACLE = """prefs AS (
  SELECT c.c_custkey AS user_id, 'segment' AS key, c.c_mktsegment AS value FROM customer c
  UNION ALL SELECT c.c_custkey, 'nation', n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT c_custkey, 'tier', CASE WHEN c_acctbal > 8000 THEN 'gold' ELSE 'silver' END
            FROM customer WHERE c_acctbal > 5000)"""


def preferences(t: Tables):
    """users with a preferences map<string,string> built from customer columns;
    the 'tier' key exists only for accounts above 5000."""
    tier = F.when(F.col("lifetime_value") > 5000,
                  F.when(F.col("lifetime_value") > 8000, "gold").otherwise("silver"))
    m = F.create_map(F.lit("segment"), F.col("plan"), F.lit("nation"), F.col("country"), F.lit("tier"), tier)
    return t.users.select("user_id", F.map_filter(m, lambda k, v: v.isNotNull()).alias("preferences"))


@register("X1_unnest_array", """
SELECT tag, count(*) AS usage_count FROM (SELECT unnest(tags) AS tag FROM products) GROUP BY tag
""", bind=("products",))
def x1(t: Tables):
    return t.products.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("usage_count"))


@register("X2_unnest_map_keys", f"""
WITH {_PREFS_ORACLE} SELECT key, count(*) AS usage_count FROM prefs GROUP BY key
""")
def x2(t: Tables):
    return preferences(t).select(F.explode(F.map_keys("preferences")).alias("key")) \
        .groupBy("key").agg(F.count(F.lit(1)).alias("usage_count"))


@register("X3_unnest_key_value", f"""
WITH {_PREFS_ORACLE} SELECT key, value, count(*) AS cnt FROM prefs GROUP BY key, value
""")
def x3(t: Tables):
    return preferences(t).select(F.explode("preferences").alias("key", "value")) \
        .groupBy("key", "value").agg(F.count(F.lit(1)).alias("cnt"))


@register("X4_most_common_value", f"""
WITH {_PREFS_ORACLE}, kv AS (SELECT key, value, count(*) AS cnt FROM prefs GROUP BY key, value)
SELECT key, arg_max(value, (cnt, value)) AS most_common_value, max(cnt) AS occurrence_count FROM kv GROUP BY key
""")
def x4(t: Tables):
    kv = x3(t)
    return kv.groupBy("key").agg(F.max_by("value", F.struct("cnt", "value")).alias("most_common_value"),
                                 F.max("cnt").alias("occurrence_count"))


@register("X5_array_filter", """
SELECT product_id, category, array_to_string(list_sort(list_filter(tags, lambda x: x LIKE 'r%')), ',') AS r_tags,
       len(list_filter(tags, lambda x: x LIKE 'r%')) AS r_tag_count
FROM products WHERE len(list_filter(tags, lambda x: x LIKE 'r%')) > 0
""", bind=("products",))
def x5(t: Tables):
    r = F.filter("tags", lambda x: x.like("r%"))
    return t.products.select("product_id", "category", r.alias("r")).where(F.size("r") > 0) \
        .select("product_id", "category", arr_str("r").alias("r_tags"), F.size("r").alias("r_tag_count"))


@register("X6_array_map", """
SELECT product_id, name, array_to_string(list_sort(list_transform(tags, lambda x: concat(x, '_v2'))), ',') AS transformed_tags
FROM products WHERE list_contains(list_transform(tags, lambda x: concat(x, '_v2')), 'ring_v2')
""", bind=("products",))
def x6(t: Tables):
    m = F.transform("tags", lambda x: F.concat(x, F.lit("_v2")))
    return t.products.select("product_id", "name", m.alias("m")).where(F.array_contains("m", "ring_v2")) \
        .select("product_id", "name", arr_str("m").alias("transformed_tags"))


@register("X7_array_exists", """
SELECT product_id, name FROM products WHERE list_bool_or(list_transform(tags, lambda x: x = 'bolt'))
""", bind=("products",))
def x7(t: Tables):
    return t.products.where(F.exists("tags", lambda x: x == "bolt")).select("product_id", "name")


@register("X8_intersect_constant", """
SELECT product_id, category, array_to_string(list_sort(list_intersect(tags, ['red','blue','new'])), ',') AS shared_tags,
       len(list_intersect(tags, ['red','blue','new'])) AS overlap_count
FROM products WHERE len(list_intersect(tags, ['red','blue','new'])) > 0
ORDER BY overlap_count DESC, category, product_id LIMIT 30
""", bind=("products",))
def x8(t: Tables):
    const = F.array(F.lit("red"), F.lit("blue"), F.lit("new"))
    s = F.array_intersect("tags", const)
    d = t.products.select("product_id", "category", s.alias("s")).where(F.size("s") > 0)
    return top_k(d.select("product_id", "category", arr_str("s").alias("shared_tags"), F.size("s").alias("overlap_count")),
                 30, F.col("overlap_count").desc(), F.col("category"), F.col("product_id"))


@register("X9_intersect_subquery", """
WITH expensive AS (SELECT DISTINCT unnest(tags) AS tag FROM products WHERE price > 990),
     cheap AS (SELECT product_id, unnest(tags) AS tag FROM products WHERE price <= 990)
SELECT product_id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS shared_tags, count(DISTINCT tag) AS n_shared
FROM cheap WHERE tag IN (SELECT tag FROM expensive) GROUP BY product_id
""", bind=("products",))
def x9(t: Tables):
    """Tags each cheap product shares with the set of expensive-product tags.

    The 'set from another query' is kept distributed: a distinct tag table
    semi-joined to exploded cheap tags, rather than one broadcast array
    whose size would grow with the vocabulary."""
    p = t.products
    expensive = p.where(F.col("price") > 990).select(F.explode("tags").alias("tag")).distinct()
    cheap = p.where(F.col("price") <= 990).select("product_id", F.explode("tags").alias("tag"))
    shared = cheap.join(expensive, "tag", "left_semi")
    return shared.groupBy("product_id").agg(arr_str(F.collect_set("tag")).alias("shared_tags"),
                                            F.countDistinct("tag").alias("n_shared"))


@register("X10_unnest_join_facts", """
WITH ptags AS (SELECT product_id, unnest(tags) AS tag FROM products)
SELECT pt.tag, count(*) AS total_events, count(*) FILTER (WHERE e.event_type = 'purchase') AS purchases,
       round(count(*) FILTER (WHERE e.event_type = 'purchase') * 100.0 / count(*), 2) AS conversion_rate
FROM event_facts e JOIN ptags pt ON e.product_id = pt.product_id
GROUP BY pt.tag HAVING count(*) >= 100
""", bind=("products", "event_facts"))
def x10(t: Tables):
    ptags = t.products.select("product_id", F.explode("tags").alias("tag"))
    e = t.event_facts.select("product_id", "event_type")
    j = e.join(ptags, "product_id")
    purchases = F.count_if(F.col("event_type") == "purchase")
    return (j.groupBy("tag").agg(F.count(F.lit(1)).alias("total_events"), purchases.alias("purchases"),
                                 F.round(purchases * 100.0 / F.count(F.lit(1)), 2).alias("conversion_rate"))
            .where(F.col("total_events") >= 100))


# ---------------------------------------------------------------- scalar functions

from quarry.functions.text import DOMAIN_RE, HOST_RE, PATH_RE, enum_code, registered_domain, url_path  # noqa: E402


@register("F15_url_parts", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '{PATH_RE}', 1) AS path,
                  regexp_extract(regexp_replace(lower(regexp_extract(url, '{HOST_RE}', 1)), '^www\\.', ''), '{DOMAIN_RE}', 1) AS domain
           FROM pages)
SELECT domain, count(*) AS n_pages, count(DISTINCT path) AS n_paths,
       count(*) FILTER (WHERE position('/en/' IN path) > 0) AS en_pages
FROM u GROUP BY domain
""")
def f15(t: Tables):
    """path(), cutToFirstSignificantSubdomain() and position() over page URLs."""
    u = t.pages.select("page_id", url_path("url").alias("path"), registered_domain("url").alias("domain"))
    return u.groupBy("domain").agg(F.count("*").alias("n_pages"), F.countDistinct("path").alias("n_paths"),
                                   F.count_if(F.locate("/en/", F.col("path")) > 0).alias("en_pages"))


# Segment enum codes.
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}


@register("F16_enum_codes", """
SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                         WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS segment_code,
       count(*) AS n_customers, CAST(min(c_custkey) AS BIGINT) AS first_key
FROM customer GROUP BY 1
""")
def f16(t: Tables):
    """toInt8(enum): a declared literal code map, then grouping by the code."""
    return t.customer.groupBy(enum_code("c_mktsegment", SEGMENT_CODES).alias("segment_code")).agg(
        F.count("*").alias("n_customers"), F.min("c_custkey").alias("first_key"))

"""A SQL query log derived from ``orders`` (one logged query per order).

Each order row fills one of six query templates with its own values, plus
a natural-language question and a 'predicted' SQL text (a different
template for every third query), so the log grows with the data and the
mining operators have realistic SQL to chew on.  ``QUERY_LOG_SQL`` builds
the identical table in DuckDB for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import spread
from quarry.sources.tables import Tables

# Fixed template texts (printf style; arguments listed per template).
TEMPLATES = [
    ("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '%s' "
     "GROUP BY o_orderstatus ORDER BY n DESC LIMIT %d",
     "How many orders per status have priority %s? Show the top %d.", ("prio", "k")),
    ("SELECT c.c_name, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
     "WHERE o.o_totalprice > %d GROUP BY c.c_name -- top spenders",
     "What is the total order value for each customer with orders above %d?", ("price",)),
    ("WITH recent AS (SELECT * FROM orders WHERE o_orderdate >= '%s') "
     "SELECT o_custkey, avg(o_totalprice) AS avg_price FROM recent GROUP BY o_custkey",
     "Average order price per customer since %s, monthly trend", ("day",)),
    ("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rnk "
     "FROM orders /* ranked */ WHERE o_custkey = %d",
     "Rank the orders of customer %d by price", ("cust",)),
    ("SELECT l_returnflag, countIf(l_discount > 0.0%d) AS discounted FROM lineitem "
     "GROUP BY l_returnflag ORDER BY l_returnflag",
     "Compare the discount rate by return flag for discounts above %d percent", ("disc",)),
    ("SELECT max(o_totalprice) AS top_price, min(o_orderdate) FROM orders "
     "WHERE o_orderstatus = '%s' AND toYear(o_orderdate) = %d",
     "What is the highest order price with status %s in %d?", ("status", "year")),
]


def _args(kind: str):
    return {
        "prio": F.col("o_orderpriority"), "k": (F.col("o_orderkey") % 20 + 1).cast("int"),
        "price": (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("bigint"),
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "cust": F.col("o_custkey"),
        "disc": (F.col("o_orderkey") % 10).cast("int"), "status": F.col("o_orderstatus"),
        "year": F.year("o_orderdate"),
    }[kind]


_ARGS_SQL = {
    "prio": "o_orderpriority", "k": "CAST(o_orderkey % 20 + 1 AS INTEGER)",
    "price": "CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT)", "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "cust": "o_custkey", "disc": "CAST(o_orderkey % 10 AS INTEGER)", "status": "o_orderstatus",
    "year": "year(o_orderdate)",
}


def _pick(which: int, kind: int):
    expr = None
    for i, tpl in enumerate(TEMPLATES):
        text = F.format_string(tpl[kind], *[_args(a) for a in tpl[2]])
        expr = F.when(F.lit(which) == -1, None) if expr is None else expr
        expr = expr.when(F.col("_tid" if which == 0 else "_pid") == i, text)
    return expr


def query_log(t: Tables) -> DataFrame:
    """query_log(query_id, template_id, question, gold_sql, pred_sql)."""
    o = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"))
    o = o.withColumn("_tid", (F.col("o_orderkey") % 6).cast("int")).withColumn(
        "_pid", F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") + 1) % 6).otherwise(F.col("o_orderkey") % 6)
        .cast("int"))
    return o.select(F.col("o_orderkey").alias("query_id"), F.col("_tid").alias("template_id"),
                    _pick(0, 1).alias("question"), _pick(0, 0).alias("gold_sql"), _pick(1, 0).alias("pred_sql"))


def _sql_case(col: str, kind: int) -> str:
    arms = []
    for i, tpl in enumerate(TEMPLATES):
        fmt = tpl[kind].replace("'", "''")
        args = ", ".join(_ARGS_SQL[a] for a in tpl[2])
        arms.append(f"WHEN {col} = {i} THEN printf('{fmt}', {args})")
    return "CASE " + " ".join(arms) + " END"


QUERY_LOG_SQL = (
    "qlb AS (SELECT *, CAST(o_orderkey % 6 AS INTEGER) AS _tid, "
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 1) % 6 ELSE o_orderkey % 6 END AS INTEGER) AS _pid FROM orders), "
    f"query_log AS (SELECT o_orderkey AS query_id, _tid AS template_id, {_sql_case('_tid', 1)} AS question, "
    f"{_sql_case('_tid', 0)} AS gold_sql, {_sql_case('_pid', 0)} AS pred_sql FROM qlb)"
)

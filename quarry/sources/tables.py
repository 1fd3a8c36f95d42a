"""Driver-table scans (IO1) and the analytics views bound onto them.

The workload's four-table web-analytics model (events, users, sessions,
products) is bound to the TPC-H-like driver tables; the binding is a set
of projections/joins that Catalyst folds into the consuming query, so
filters and column pruning still reach the parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLE_NAMES) -> None:
    """IO1: expose every driver table to ``spark.sql`` by its name."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


class Tables:
    """Lazy accessor: ``Tables(spark, d).lineitem`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    # ---- analytics-model bindings -------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        """users(user_id, name, plan, country, region_key, lifetime_value)."""
        n = F.broadcast(self.nation.select("n_nationkey", "n_name", "n_regionkey"))  # 25 rows by definition
        return (self.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                        F.col("c_mktsegment").alias("plan"), F.col("n_name").alias("country"),
                        F.col("n_regionkey").alias("region_key"),
                        F.col("c_acctbal").alias("lifetime_value")))

    @cached_property
    def sessions(self) -> DataFrame:
        """sessions(session_id, user_id, start_time, amount, status, priority, is_converted)."""
        return self.orders.select(
            F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("start_time"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_converted"))

    @cached_property
    def products(self) -> DataFrame:
        """products(product_id, name, category, subcategory, price, rating, tags)."""
        return self.part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"),
            F.col("p_retailprice").alias("price"), F.col("p_size").alias("rating"),
            F.split(F.col("p_name"), " ").alias("tags"))

    @cached_property
    def event_facts(self) -> DataFrame:
        """events with the JSON property ``k`` exposed as text and as product id."""
        k = F.get_json_object(F.col("props"), "$.k")
        return self.events.select(
            "event_id", "ts", "user_id", "event_type", "value", "props",
            k.alias("prop_k"), F.coalesce(k.try_cast("bigint"), F.lit(0)).alias("product_id"))


# DuckDB text of the same bindings, for oracle SQL (prepended as CTEs).
ORACLE_BINDINGS = {
    "users": "users AS (SELECT c.c_custkey AS user_id, c.c_name AS name, c.c_mktsegment AS plan, "
             "n.n_name AS country, n.n_regionkey AS region_key, c.c_acctbal AS lifetime_value "
             "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)",
    "sessions": "sessions AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderdate AS start_time, "
                "o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS priority, "
                "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_converted FROM orders)",
    "products": "products AS (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, "
                "p_brand AS subcategory, p_retailprice AS price, p_size AS rating, "
                "string_split(p_name, ' ') AS tags FROM part)",
    "event_facts": "event_facts AS (SELECT event_id, ts, user_id, event_type, value, props, "
                   "json_extract_string(props, '$.k') AS prop_k, "
                   "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS product_id FROM events)",
}


def with_bindings(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named binding CTEs (DuckDB dialect)."""
    ctes = ", ".join(ORACLE_BINDINGS[n] for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"

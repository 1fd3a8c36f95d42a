"""IO ops: scans, delimited/JSON loads, sinks, layouts, flattening, generator.

Each load test writes driver-table data to a fresh folder under the
session's shared checkpoint directory and reads it back through the
loader, so the round trip is verified against the original table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from quarry.plans.eval_bindings import RUN_LOG_SQL, run_log
from quarry.plans.querylog_bindings import QUERY_LOG_SQL, query_log
from quarry.plans.registry import register
from quarry.plans.workload_select import preferences
from quarry.session import scratch_path
from quarry.sources.delimited import read_delimited, write_delimited
from quarry.sources.generator import DEVICES, EVENT_MIX, PROPERTIES, generate
from quarry.sources.jsonlogs import read_corpus, read_run_log
from quarry.sources.sinks import write_batched, write_month_layout, write_report
from quarry.sources.tables import TABLE_NAMES, Tables

LINEITEM_SCHEMA = StructType([
    StructField("l_orderkey", LongType()), StructField("l_partkey", LongType()), StructField("l_suppkey", LongType()),
    StructField("l_linenumber", IntegerType()), StructField("l_quantity", DoubleType()),
    StructField("l_extendedprice", DoubleType()), StructField("l_discount", DoubleType()),
    StructField("l_tax", DoubleType()), StructField("l_returnflag", StringType()),
    StructField("l_linestatus", StringType()), StructField("l_shipdate", TimestampNTZType())])


@register("IO1_table_scan", """
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_returnflag
""")
def io1(t: Tables):
    """Parquet scan with a pushed-down filter and a two-column projection
    (ReadSchema holds only the referenced columns)."""
    li = t.lineitem.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@register("IO2_tsv_load", "SELECT * FROM lineitem")
def io2(t: Tables):
    """Gzip TSV round trip of ``lineitem`` through the explicit-schema loader."""
    path = scratch_path(t.spark, "lineitem-tsv")
    write_delimited(t.lineitem, path, "\t", compression="gzip")
    return read_delimited(t.spark, path, LINEITEM_SCHEMA, "\t")


_SSB_TABLES = {
    "customer": ("c_custkey", StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()),
                                          StructField("c_nationkey", IntegerType()), StructField("c_acctbal", DoubleType()),
                                          StructField("c_mktsegment", StringType())])),
    "supplier": ("s_suppkey", StructType([StructField("s_suppkey", LongType()), StructField("s_name", StringType()),
                                          StructField("s_nationkey", IntegerType()), StructField("s_acctbal", DoubleType())])),
    "part": ("p_partkey", StructType([StructField("p_partkey", LongType()), StructField("p_name", StringType()),
                                      StructField("p_brand", StringType()), StructField("p_type", StringType()),
                                      StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())])),
    "orders": ("o_orderkey", StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
                                         StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
                                         StructField("o_orderdate", TimestampNTZType()),
                                         StructField("o_orderpriority", StringType())])),
    "lineitem": ("l_orderkey", LINEITEM_SCHEMA),
}


@register("IO3_pipe_load", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST(sum({k}) AS BIGINT) AS key_sum FROM {n}" for n, (k, _) in _SSB_TABLES.items()))
def io3(t: Tables):
    """Five tables through the '|'-delimited loader; rows and key sums per table."""
    out = None
    for name, (key, schema) in _SSB_TABLES.items():
        path = scratch_path(t.spark, f"{name}-pipe")
        write_delimited(getattr(t, name), path, "|")
        df = read_delimited(t.spark, path, schema, "|")
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.sum(key).alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


_RUN_SCHEMA = StructType([StructField("config", StringType()), StructField("query_id", LongType()),
                          StructField("executed", IntegerType()), StructField("correct", IntegerType())])


@register("IO4_run_log_bad_lines", f"""
WITH {RUN_LOG_SQL}
SELECT config, count(*) FILTER (WHERE executed = 1) AS n_good FROM run_log GROUP BY config
UNION ALL SELECT '_rejected', count(*) FILTER (WHERE executed = 0) FROM run_log
""")
def io4(t: Tables):
    """JSON-lines run log where every unexecuted run was written as a broken
    line; good rows per config plus the rejected-line count."""
    r = run_log(t)
    line = F.when(F.col("executed") == 0, F.concat(F.lit('{"config": "'), F.col("config"), F.lit('", broken')))\
        .otherwise(F.to_json(F.struct("config", "query_id", "executed", "correct")))
    path = scratch_path(t.spark, "runlog-jsonl")
    r.select(line.alias("value")).write.mode("overwrite").text(path)
    good, bad = read_run_log(t.spark, path, _RUN_SCHEMA)
    g = good.groupBy("config").agg(F.count("*").alias("n_good"))
    b = bad.agg(F.lit("_rejected").alias("config"), F.count("*").alias("n_good"))
    return g.unionByName(b)


_CORPUS_RECORD = StructType([StructField("id", LongType()), StructField("dataset", StringType()),
                             StructField("category", StringType()), StructField("sql", StringType()),
                             StructField("tables_used", ArrayType(StringType()))])


@register("IO5_corpus_read", f"""
WITH {QUERY_LOG_SQL}
SELECT CASE WHEN template_id < 3 THEN 'analytics' ELSE 'ssb' END AS dataset, template_id AS category, count(*) AS n
FROM query_log WHERE template_id < 3 GROUP BY 1, 2
""")
def io5(t: Tables, batch: int = 1000):
    """Query corpus written as JSON documents of at most ``batch`` records —
    half with an object root ``{{"queries": [...]}}``, half with a list root —
    read back with the dataset filter."""
    q = query_log(t).select(F.col("query_id").alias("id"),
                            F.when(F.col("template_id") < 3, "analytics").otherwise("ssb").alias("dataset"),
                            F.col("template_id").cast("string").alias("category"), F.col("gold_sql").alias("sql"),
                            F.array(F.lit("orders")).alias("tables_used"))
    docs = q.groupBy(F.floor(F.col("id") / batch).alias("b")).agg(F.collect_list(F.struct(*q.columns)).alias("qs"))
    text = F.when(F.col("b") % 2 == 0, F.to_json(F.struct(F.col("qs").alias("queries")))).otherwise(F.to_json("qs"))
    path = scratch_path(t.spark, "corpus")
    docs.select(F.col("b"), text.alias("value")).write.mode("overwrite").partitionBy("b").text(path)
    recs = read_corpus(t.spark, path, _CORPUS_RECORD, dataset="analytics")
    return recs.groupBy("dataset", F.col("category").cast("int").alias("category")).agg(F.count("*").alias("n"))


@register("IO6_report_sink", f"""
WITH {RUN_LOG_SQL}
SELECT fmt, config, n, correct_rate FROM (SELECT config, count(*) AS n, round(avg(correct), 6) AS correct_rate FROM run_log GROUP BY config),
  (SELECT unnest(['csv', 'json']) AS fmt)
""")
def io6(t: Tables):
    """Metrics report written as CSV and as JSON lines, read back from both."""
    m = run_log(t).groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("correct_rate"))
    pc, pj = scratch_path(t.spark, "report-csv"), scratch_path(t.spark, "report-json")
    write_report(m, pc, "csv")
    write_report(m, pj, "json")
    schema = "config string, n bigint, correct_rate double"
    c = t.spark.read.schema(schema).option("header", "true").csv(pc).withColumn("fmt", F.lit("csv"))
    j = t.spark.read.schema(schema).json(pj).withColumn("fmt", F.lit("json"))
    return c.unionByName(j).select("fmt", "config", "n", "correct_rate")


@register("IO7_batched_write", """
SELECT count(*) AS n_rows, TRUE AS files_ok FROM lineitem
""")
def io7(t: Tables, rows_per_file: int = 10_000):
    path = scratch_path(t.spark, "lineitem-batched")
    write_batched(t.lineitem, path, rows_per_file)
    back = t.spark.read.parquet(path).withColumn("_f", F.input_file_name())
    per_file = back.groupBy("_f").agg(F.count("*").alias("c"))
    return per_file.agg(F.sum("c").alias("n_rows"), (F.max("c") <= rows_per_file).alias("files_ok"))


@register("IO8_month_layout", """
SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS ym, event_type, count(*) AS n FROM events
WHERE CAST(strftime(ts, '%Y%m') AS INTEGER) = 202401 GROUP BY 1, 2
""")
def io8(t: Tables):
    """Events written month-partitioned and sorted; a month filter then
    prunes partitions at read time (PartitionFilters in the scan)."""
    path = scratch_path(t.spark, "events-by-month")
    write_month_layout(t.events, path, "ts", ["event_type", "ts"])
    back = t.spark.read.parquet(path).where(F.col("ym") == 202401)
    return back.groupBy("ym", "event_type").agg(F.count("*").alias("n"))


@register("IO9_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}"
                                               for n in TABLE_NAMES))
def io9(t: Tables):
    out = None
    for n in TABLE_NAMES:
        one = getattr(t, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@register("IO10_flatten_to_json", """
SELECT c.c_custkey AS user_id,
       CASE WHEN c.c_acctbal > 5000 THEN json_object('segment', c.c_mktsegment, 'nation', n.n_name,
                 'tier', CASE WHEN c.c_acctbal > 8000 THEN 'gold' ELSE 'silver' END)
            ELSE json_object('segment', c.c_mktsegment, 'nation', n.n_name) END::VARCHAR AS preferences_json,
       CAST(CAST(c.c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS lifetime_value
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def io10(t: Tables):
    """Map column to JSON text and a DECIMAL(12,2) value to double (the
    portable form of map/array/decimal columns)."""
    p = preferences(t)
    u = t.users.select("user_id", F.col("lifetime_value").cast("decimal(12,2)").alias("ltv"))
    return p.join(u, "user_id").select("user_id", F.to_json("preferences").alias("preferences_json"),
                                       F.col("ltv").cast("double").alias("lifetime_value"))


_INVARIANTS = ["devices", "event kinds", "events inside their session", "one product a part", "one user a customer", "product references", "property values", "sessions of known users", "skewed users"]


@register("IO11_synthetic_generator", "SELECT unnest([" + ", ".join(f"'{x}'" for x in _INVARIANTS) + "]) AS invariant, true AS holds")
def io11(t: Tables):
    """Synthetic users, products, sessions and events scaled from ``customer``
    and ``part``; one row for each property that the tables must have: links
    between them, attributes copied from parents, shares of weighted draws
    within four standard deviations, skew."""
    def written(df, name):
        path = scratch_path(t.spark, f"generated-{name}")
        df.write.parquet(path)
        return t.spark.read.parquet(path)

    users, products, sessions, events = (written(x, n) for x, n in zip(generate(t.customer, t.part), ("users", "products", "sessions", "events")))
    zero = F.lit(0).cast("bigint")

    def shares(df, column, weights):
        """Every weighted value's count is near what its weight says."""
        total = sum(w for _, w in weights)
        ok = F.count("*") == F.sum(F.when(F.col(column).isin([v for v, _ in weights]), 1).otherwise(0))
        for v, w in weights:
            p = w / total
            ok = ok & (F.abs(F.count_if(F.col(column) == v) - F.count("*") * p) <= 4 * F.sqrt(F.count("*") * p * (1 - p)) + 1)
        return df.agg(ok.alias("holds"))

    def none(df):
        return df.agg((F.count("*") == 0).alias("holds"))

    j = events.join(sessions.select("session_id", "start_time", "duration_seconds", F.col("user_id").alias("su"), F.col("device_type").alias("sd"), F.col("country_id").alias("sc")), "session_id", "left")
    inside = ((F.col("timestamp") >= F.col("start_time")) & (F.col("user_id") == F.col("su")) & (F.col("device_type") == F.col("sd")) & F.col("country_id").eqNullSafe(F.col("sc"))
              & (F.col("timestamp") < F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration_seconds"))))
    buys = events.where("event_type = 'purchase'").select(F.col("properties")["product_id"].cast("bigint").alias("product_id"))
    allowed = F.lit(False)
    for kind, names in PROPERTIES.items():
        fine = F.col("event_type") == kind
        for name, values in names.items():
            fine = fine & F.col("properties")[name].isin(values)
        if kind == "purchase":
            fine = fine & F.col("properties")["quantity"].cast("int").between(1, 5) & F.col("properties")["amount"].cast("double").between(5, 500)
        else:
            fine = fine & ~F.map_contains_key("properties", F.lit("product_id"))
        allowed = allowed | fine
    per_user = sessions.groupBy("user_id").agg(F.count("*").alias("n"))
    many = users.agg(F.count("*").alias("users")).crossJoin(per_user.agg(F.coalesce(F.max("n"), zero).alias("most"), F.coalesce(F.sum("n"), zero).alias("all")))
    same = lambda a, b, key: (a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).crossJoin(a.agg(F.count_distinct(key).alias("d")))
                              .select(((F.col("a") == F.col("b")) & (F.col("a") == F.col("d"))).alias("holds")))
    found = {
        "one user a customer": same(users, t.customer, "user_id"), "one product a part": same(products, t.part, "product_id"),
        "sessions of known users": none(sessions.join(users, "user_id", "left_anti")), "events inside their session": none(j.where(~F.coalesce(inside, F.lit(False)))),
        "product references": none(buys.join(products, "product_id", "left_anti")), "property values": none(events.where(~F.coalesce(allowed, F.lit(False)))),
        "event kinds": shares(events, "event_type", EVENT_MIX), "devices": shares(sessions, "device_type", DEVICES),
        "skewed users": many.select((F.col("most") * F.col("users") >= 5 * F.col("all")).alias("holds")),
    }
    out = None
    for name, row in found.items():
        row = row.select(F.lit(name).alias("invariant"), "holds")
        out = row if out is None else out.unionByName(row)
    return out

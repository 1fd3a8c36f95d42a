"""URL filter: rules and a native logistic regression (operator 4).

A URL is judged by the longest (host, path) rule that fits, else by a
logistic regression on hashed character n-grams of host and path.  Training
and scoring use SQL functions only: the labelled table is small (at most
``MAX_LABELLED`` rows), so stochastic gradient descent is one fold over an
array of its rows, and the weights come back as one literal array.

A null URL or one without ``://`` has an empty host and path and is judged
by the method.  Rows keep their multiplicity; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 1000
BUCKETS = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# words of hosts and paths that the default labelled table is built from
BLOCK_WORDS = "spam casino pills cheap viagra poker bet jackpot loan adult porn xxx free-money crypto-win clickbait farm warez torrent scam lottery replica diet-pills hot-deals payday".split()
ALLOW_WORDS = "blog news docs wiki library school museum science research garden recipes travel history music weather health forum shop city sports books learn data maps".split()


def default_labels() -> list[tuple[str, int]]:
    """Labelled URLs by a rule from the two word lists; 1 is block."""
    rows = []
    for y, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, w in enumerate(words):
            other = words[(i + 7) % len(words)]
            tld = ("com", "net", "org")[i % 3]
            rows += [(f"http://{w}-{other}.example.{tld}/en/{100 + i}", y), (f"https://www.{other}.example.{tld}/{w}/{i}.html", y)]
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))  # null otherwise
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null.

    A rule fits its host and the host's subdomains where the path starts
    with the rule's path.
    """
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    return F.coalesce(*fits)


def grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of host and path, marked at their ends."""
    def of(text, tag, n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                           lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(tag), text.substr(i, F.lit(n)))), 1, 6), 16, 10).cast("int"), F.lit(BUCKETS)))
    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("^"), path, F.lit("$"))
    return F.array_distinct(F.concat(of(h, "h", 3), of(h, "h", 4), of(p, "p", 3), of(p, "p", 4)))


def train_weights(labelled: DataFrame, epochs: int = 25, rate: float = 0.15) -> list[float]:
    """Weights of the buckets, then the bias, rounded to 5 places: SGD over (url, label) rows in url order."""
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table is meant to be small: at most {MAX_LABELLED} rows")
    host, path = host_and_path(F.col("_url"))
    x = labelled.where("url is not null and label is not null").select(F.col("url").alias("_url"), F.col("label").cast("double").alias("y")).select("_url", "y", grams(host, path).alias("g"))
    rows = x.agg(F.sort_array(F.collect_list(F.struct("_url", "y", "g"))).alias("rows"))
    # each row as a dense vector over buckets and bias, divided by the root of its number of n-grams
    dense = F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS)),
        lambda b: F.when(F.array_contains(r["g"], b) | (b == BUCKETS), 1 / F.sqrt(F.size(r["g"]).cast("double"))).otherwise(0.0)).alias("x")))

    def step(w, r):
        margin = F.aggregate(F.zip_with(w, r["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        pull = F.lit(rate) * (r["y"] - 1 / (1 + F.exp(-margin)))
        # bound once, or it would be worked out anew for every weight
        return F.element_at(F.transform(F.array(pull), lambda p: F.zip_with(w, r["x"], lambda a, b: a + p * b)), 1)

    fold = F.aggregate(F.flatten(F.array_repeat("dense", epochs)), F.array_repeat(F.lit(0.0), BUCKETS + 1), step)
    found = rows.select(dense.alias("dense")).select(fold.alias("w")).first()["w"]
    return [round(v, 5) for v in found]


def filter_urls(pages: DataFrame, labelled: DataFrame | None, rules: list[tuple[str, str, str]], epochs: int = 25) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; ``rules`` are (verdict, host, path)."""
    spark = pages.sparkSession
    if labelled is None:
        labelled = label_table(spark)
    w = F.lit(train_weights(labelled, epochs))
    host, path = host_and_path(F.col("_url"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), grams(F.col("host"), F.col("path")).alias("g"))
    margin = F.aggregate("g", F.element_at(w, BUCKETS + 1), lambda a, b: a + F.element_at(w, b + 1)) / F.sqrt(F.size("g").cast("double"))
    return (judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("fixed"), F.round(1 / (1 + F.exp(-margin)), 6).alias("score"))
            .select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"))


def label_table(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    """Labelled URLs as a table; without Python on the executors (a SQL VALUES list)."""
    values = ", ".join("('{}', {})".format(u.replace("'", "''"), y) for u, y in (default_labels() if rows is None else rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def split_plain(url: str | None) -> tuple[str, str]:
    """Host and path in plain Python, for tests and the oracle's weights."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), tail[:end]


def grams_plain(host: str, path: str) -> list[int]:
    out = []
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in (3, 4):
            out += [int(hashlib.md5((tag + s[i:i + n]).encode()).hexdigest()[:6], 16) % BUCKETS for i in range(max(1, len(s) - n + 1))]
    return list(dict.fromkeys(out))


def weights_plain(rows: list[tuple[str, int]], epochs: int = 25, rate: float = 0.15) -> list[float]:
    """The same training in plain Python."""
    w = [0.0] * (BUCKETS + 1)
    data = [(float(y), [*grams_plain(*split_plain(u))]) for u, y in sorted(rows)]
    for _ in range(epochs):
        for y, g in data:
            x = 1 / math.sqrt(len(g))
            margin = sum(w[b] * x for b in (*sorted(g), BUCKETS))
            pull = rate * (y - 1 / (1 + math.exp(-margin)))
            for b in (*g, BUCKETS):
                w[b] += pull * x
    return [round(v, 5) for v in w]

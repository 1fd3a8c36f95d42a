"""Query-log and text mining (L ops): all per-row work is built-in regex /
array expressions; cross-row work is explode + join + aggregate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.joins import broadcast_if_small, spread
from quarry.session import scratch_path

# Words that are never table or column names.
SQL_KEYWORDS = [
    "select", "from", "where", "join", "left", "right", "inner", "outer",
    "cross", "full", "on", "and", "or", "not", "in", "exists", "between",
    "like", "is", "null", "true", "false", "as", "case", "when", "then",
    "else", "end", "group", "by", "order", "having", "limit", "offset",
    "union", "all", "intersect", "except", "insert", "into", "update",
    "delete", "create", "alter", "drop", "table", "index", "view",
    "with", "recursive", "distinct", "asc", "desc", "nulls", "first",
    "last", "over", "partition", "rows", "range", "unbounded", "preceding",
    "following", "current", "row", "filter", "within", "any", "some",
    "array", "global", "local", "prewhere", "sample", "final", "format",
    "settings", "using", "natural", "lateral", "values", "set",
    "count", "sum", "avg", "min", "max", "if", "multiif",
]

# SQL-significant question words (similarity boost).
SIMILARITY_KEYWORDS = [
    "count", "sum", "average", "avg", "total", "max", "min", "each", "per", "group", "rank", "top", "first",
    "last", "trend", "monthly", "daily", "weekly", "growth", "rate", "join", "compare", "between",
    "difference", "ratio", "percentage", "percent", "distinct", "unique", "consecutive", "running",
    "cumulative", "window", "previous", "next", "lag", "lead",
]

# Structural labels of SQL text (regex on upper-cased SQL).
SKELETON_RULES = [
    (r"\bCOUNT\s*\(", ["AGG_COUNT", "HAS_AGGREGATION"]), (r"\bSUM\s*\(", ["AGG_SUM", "HAS_AGGREGATION"]),
    (r"\bAVG\s*\(", ["AGG_AVG", "HAS_AGGREGATION"]), (r"\bMAX\s*\(", ["AGG_MAX", "HAS_AGGREGATION"]),
    (r"\bMIN\s*\(", ["AGG_MIN", "HAS_AGGREGATION"]),
    (r"\b(COUNTIF|SUMIF|AVGIF|UNIQEXACTIF)\s*\(", ["HAS_CONDITIONAL_AGG", "HAS_AGGREGATION"]),
    (r"\bGROUP\s+BY\b", ["HAS_GROUP_BY"]), (r"\bOVER\s*\(", ["HAS_WINDOW"]), (r"\bJOIN\b", ["HAS_JOIN"]),
    (r"TOSTARTOFMONTH|TOSTARTOFWEEK|TODATE|TOYEAR|TOMONTH|DATEDIFF|TOSTARTOFDAY", ["HAS_TIME"]),
    (r"\bORDER\s+BY\b", ["HAS_ORDER"]), (r"\bLIMIT\b", ["HAS_LIMIT"]),
]

# Question words -> structural labels.
QUESTION_AGG_WORDS = [
    ("count", "AGG_COUNT"), ("how many", "AGG_COUNT"), ("total", "AGG_SUM"), ("sum", "AGG_SUM"),
    ("average", "AGG_AVG"), ("avg", "AGG_AVG"), ("mean", "AGG_AVG"), ("maximum", "AGG_MAX"), ("max", "AGG_MAX"),
    ("highest", "AGG_MAX"), ("minimum", "AGG_MIN"), ("min", "AGG_MIN"), ("lowest", "AGG_MIN"),
]
QUESTION_TABLE_WORDS = ["users", "events", "sessions", "products"]
QUESTION_FLAG_WORDS = {
    "HAS_GROUP_BY": ["for each", "per ", "by ", "grouped", "breakdown", "distribution"],
    "HAS_WINDOW": ["rank", "running", "cumulative", "row number", "consecutive", "previous", "next", "lag",
                   "lead", "partition", "quartile", "ntile", "dense rank", "over time within"],
    "HAS_JOIN": ["join", "across", "from both", "combined with", "along with"],
    "HAS_TIME": ["monthly", "daily", "weekly", "yearly", "over time", "trend", "month", "day", "week", "year",
                 "date", "time series", "growth", "month over month", "year over year"],
    "HAS_ORDER": ["order", "sort", "rank", "highest", "lowest", "most", "least"],
    "HAS_CONDITIONAL_AGG": ["rate", "ratio", "percentage", "percent", "proportion", "share"],
    "HAS_SUBQUERY": ["among", "within the", "of those", "that have", "who have"],
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it.

    A Column is an expression, not a value: naming it twice in another
    expression evaluates it twice, and once per element inside a lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(s: Column, rx: str) -> Column:
    """``s`` matches ``rx``, a pattern of capital words, all of them needed or, with ``|``, one of them.

    The words are looked for before the pattern, which costs many times as
    much; a pattern that is nothing but a choice of words is not needed at all.
    """
    found = reduce(or_ if "|" in rx else and_, [s.contains(w) for w in re.findall("[A-Z]+", rx)])
    return found if re.fullmatch("[A-Z|]+", rx) else found & s.rlike(rx)


def normalize_sql(sql) -> Column:
    """Strip -- and /* */ comments, blank string literals, collapse spaces."""
    s = F.regexp_replace(_c(sql), r"--[^\n]*", " ")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", " ")
    s = F.regexp_replace(s, r"'[^']*'", "''")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def mask_values(sql) -> Column:
    """Mask string literals, compared numbers and LIMIT counts."""
    s = F.regexp_replace(_c(sql), r"'[^']*'", "'VALUE'")
    s = F.regexp_replace(s, r"(<=|>=|<>|!=|=|<|>)\s*(\d+(\.\d+)?)", "$1 NUMBER")
    return F.regexp_replace(s, r"(?i)\blimit\s+\d+", "LIMIT N")


def _no_keyword(name: Column) -> Column:
    return ~name.isin(SQL_KEYWORDS)


# Patterns that start at a word's start only and never give a word's end back:
# the same matches in one look at each word, not one at each of its letters.
_CTE = r"(?i)(?<!\w)(\w++)\s++as\s*+\("
_CALLED = r"(?<![A-Za-z_])([A-Za-z_]\w*+)\s*+\("
_QUALIFIED = r"(?<![A-Za-z_])([A-Za-z_]\w*+)\.([A-Za-z_]\w*+)"


def cte_names(norm_sql) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(norm_sql), F.lit(_CTE), 1),
                                        lambda x: F.lower(x)))


def table_refs(norm_sql) -> Column:
    """Distinct table names after FROM / JOIN (database prefix dropped),
    minus CTE names and keywords."""
    def refs(s: Column) -> Column:
        raw = F.regexp_extract_all(s, F.lit(r"(?i)(?:from|join)\s+([a-z_][a-z0-9_.]*)"), 1)
        names = F.transform(raw, lambda x: F.lower(F.element_at(F.split(x, r"\."), -1)))
        return F.array_sort(F.filter(F.array_except(names, cte_names(s)), _no_keyword))
    return _let(_c(norm_sql), refs)


def alias_refs(norm_sql) -> Column:
    raw = F.regexp_extract_all(_c(norm_sql), F.lit(r"(?i)(?:from|join)\s+[a-z_][a-z0-9_.]*\s+(?:as\s+)?([a-z_]\w*)"), 1)
    return F.filter(F.array_distinct(F.transform(raw, lambda x: F.lower(x))), _no_keyword)


def column_refs(norm_sql) -> Column:
    """Column names: qualified ``prefix.col`` references whose prefix is a
    table or alias, plus bare identifiers of the SELECT / WHERE / GROUP BY /
    ORDER BY / HAVING bodies, minus keywords, function names (identifier
    followed by '('), tables, aliases, CTE names and SELECT aliases."""
    def qualified(s: Column, known: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(s, F.lit(_QUALIFIED), 0), lambda x: F.split(F.lower(x), r"\."))
        return F.transform(F.filter(parts, lambda x: F.array_contains(known, x[0]) | x[0].isin(SQL_KEYWORDS)), lambda x: x[1])

    def bare(body: Column, known: Column) -> Column:
        funcs = F.transform(F.regexp_extract_all(body, F.lit(_CALLED), 1), lambda x: F.lower(x))
        idents = F.transform(F.regexp_extract_all(body, F.lit(r"([A-Za-z_]\w*)"), 1), lambda x: F.lower(x))
        return F.filter(F.array_except(idents, F.array_union(known, funcs)), lambda x: (F.length(x) > 1) & _no_keyword(x))

    def refs(s: Column, known: Column, selects: Column) -> Column:
        # every clause body of the text, those of common table expressions included
        bodies = [F.array_join(F.regexp_extract_all(s, F.lit(p), 1), " ") for p in [
            r"(?is)\bwhere\b(.*?)(?:\b(?:group|order|limit|having)\b|$)",
            r"(?is)\bgroup\s+by\b(.*?)(?:\b(?:order|limit|having)\b|$)",
            r"(?is)\border\s+by\b(.*?)(?:\blimit\b|$)", r"(?is)\bhaving\b(.*?)(?:\b(?:order|limit)\b|$)"]]
        # qualified references are handled apart
        body = F.regexp_replace(F.concat_ws(" ", selects, *bodies), _QUALIFIED, " ")
        sel_alias = F.transform(F.regexp_extract_all(selects, F.lit(r"(?i)\bas\s+([A-Za-z_]\w*)"), 1), lambda x: F.lower(x))
        names = F.array_union(qualified(s, known), _let(body, lambda b: bare(b, known)))
        return F.array_sort(F.array_except(names, sel_alias))

    def with_known(s: Column) -> Column:
        known = F.array_union(F.array_union(table_refs(s), alias_refs(s)), cte_names(s))
        selects = F.array_join(F.regexp_extract_all(s, F.lit(r"(?is)\bselect\b(.*?)\bfrom\b"), 1), " ")
        return _let(known, lambda k: _let(selects, lambda x: refs(s, k, x)))
    return _let(_c(norm_sql), with_known)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b))


def prf1(pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) of two name sets, rounded to 6; both
    empty = 1, one empty = 0."""
    tp = F.size(F.array_intersect(pred, gold)).cast("double")
    np_, ng = F.size(pred).cast("double"), F.size(gold).cast("double")
    p = F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0), 0.0).otherwise(tp / np_)
    r = F.when((np_ == 0) & (ng == 0), 1.0).when((np_ == 0) | (ng == 0), 0.0).otherwise(tp / ng)
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return F.struct(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


# Bit positions of the structural labels (for set arithmetic as integers).
LABEL_BITS = {lbl: i for i, lbl in enumerate([
    "AGG_COUNT", "AGG_SUM", "AGG_AVG", "AGG_MAX", "AGG_MIN", "HAS_AGGREGATION", "HAS_CONDITIONAL_AGG",
    "HAS_GROUP_BY", "HAS_WINDOW", "HAS_JOIN", "HAS_TIME", "HAS_ORDER", "HAS_LIMIT", "HAS_SUBQUERY"])}


def _mask(rules: list[tuple[Column, list[str]]]) -> Column:
    """A bit for every label of a rule that holds."""
    m = F.lit(0).cast("bigint")
    for holds, labels in rules:
        m = m.bitwiseOR(F.when(holds, F.lit(sum(1 << LABEL_BITS[x] for x in labels))).otherwise(F.lit(0)))
    return m


def labels_of(mask: Column) -> Column:
    """The labels of a mask, sorted."""
    return _let(mask, lambda m: F.array_compact(F.array(*[F.when(m.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(lbl)) for lbl, bit in sorted(LABEL_BITS.items())])))


def sql_skeleton_mask(sql) -> Column:
    """Structural labels of a SQL text (aggregates, group, window, join, time
    functions, order, limit, subquery) as a bitmask."""
    def mask(s: Column) -> Column:
        nested = _matches(s, r"\bWITH\b") | (F.size(F.split(s, "SELECT")) > 2)
        return _mask([(_matches(s, rx), labels) for rx, labels in SKELETON_RULES] + [(nested, ["HAS_SUBQUERY"])])
    return _let(F.upper(_c(sql)), mask)


def question_patterns_mask(text) -> Column:
    """Structural labels implied by a natural-language question, as a bitmask."""
    words = [(word, [label, "HAS_AGGREGATION"]) for word, label in QUESTION_AGG_WORDS]
    words += [(word, [label]) for label, some in QUESTION_FLAG_WORDS.items() for word in some]

    def mask(q: Column) -> Column:
        tables = sum((q.contains(name).cast("int") for name in QUESTION_TABLE_WORDS), F.lit(0))
        numbered = q.rlike(r"\b(top|first|last|bottom)\s+\d+")
        return _mask([(q.contains(word), labels) for word, labels in words] + [(numbered, ["HAS_LIMIT", "HAS_ORDER"]), (tables >= 2, ["HAS_JOIN"])])
    return _let(F.lower(_c(text)), mask)


def sql_skeleton(sql) -> Column:
    return labels_of(F.coalesce(sql_skeleton_mask(sql), F.lit(0)))


def question_patterns(text) -> Column:
    return labels_of(F.coalesce(question_patterns_mask(text), F.lit(0)))


def mask_jaccard(a, b) -> Column:
    a, b = _c(a), _c(b)
    u = F.bit_count(a.bitwiseOR(b))
    return F.when(u == 0, 0.0).otherwise(F.bit_count(a.bitwiseAND(b)) / u)


def tokens(text) -> Column:
    """Distinct lower-case [a-z0-9_]+ tokens of the whole text (the maximal
    runs of those characters)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9_]+"), F.lit(0)))


def jaccard_sets(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b)).cast("double")
    return F.when(union == 0, 0.0).otherwise(inter / union)


def token_budget(text) -> Column:
    """ceil(chars / 3.5), at least 1; 0 for empty or NULL text."""
    n = F.length(F.coalesce(_c(text), F.lit("")))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1), F.ceil(n / 3.5)).cast("bigint"))


def question_class(text) -> Column:
    """Ordered rules (first wins): scalar, top_n, time, compare, breakdown, list."""
    q = F.lower(_c(text))
    return (F.when(q.rlike(r"^(how many|what is the (total|average|highest|lowest|number))"), "scalar")
            .when(q.rlike(r"\b(top|first|bottom)\s+\d+"), "top_n")
            .when(q.rlike(r"\b(trend|monthly|daily|weekly|over time|since)\b"), "time")
            .when(q.rlike(r"\b(compare|versus|vs)\b"), "compare")
            .when(q.rlike(r"\b(per|each|by)\b"), "breakdown")
            .otherwise("list"))


def top_n_value(text) -> Column:
    v = F.regexp_extract(F.lower(_c(text)), r"\b(?:top|first|bottom)\s+(\d+)", 1)
    return F.when(v == "", F.lit(None)).otherwise(v.cast("int"))


def extract_sql(text) -> Column:
    """SQL mined from free text: the longest ```sql fenced block, else a
    leading SELECT/WITH statement, else the first embedded SELECT."""
    t = _c(text)
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```(?:sql)?\s*(.*?)```"), 1)
    longest = F.element_at(F.array_sort(F.transform(blocks, lambda b: F.struct((-F.length(F.trim(b))).alias("l"),
                                                                               F.trim(b).alias("s")))), 1)["s"]
    lead = F.regexp_extract(t, r"(?is)^\s*((?:select|with)\b.*)$", 1)
    embedded = F.regexp_extract(t, r"(?is)\b(select\b[^;]*)", 1)
    return (F.when(F.size(blocks) > 0, longest)
            .when(lead != "", F.trim(lead)).when(embedded != "", F.trim(embedded)))


# ------------------------------------------------------------------ top-k

def top_k_similar(questions: DataFrame, examples: DataFrame, k: int = 3) -> DataFrame:
    """Per question, the k examples with the best combined score
    0.6*(Jaccard + min(0.05*shared keywords, 0.15)) + 0.4*pattern Jaccard,
    ties by example id.  ``questions(qid, text)``, ``examples(eid, text, sql)``.

    Exact, through an inverted index over the classes of equal examples and
    block bounds (``inverted_index.top_k``): only blocks that may hold a
    better example than the k-th known one are opened.  Sides without tokens
    score 0; examples with a null id are left out.
    """
    from quarry.operators.inverted_index import ClassTree, top_k
    none = F.array().cast("array<string>")

    def token_set(c: str) -> Column:
        return F.array_sort(F.coalesce(tokens(c), none))

    def score(nq, ne, inter, keywords, pattern):
        jac = F.coalesce(F.try_divide(inter, nq + ne - inter), F.lit(0.0))
        return 0.6 * (jac + F.least(keywords * 0.05, F.lit(0.15))) + 0.4 * pattern

    q = questions.select("qid", token_set("text").alias("toks"), F.coalesce(question_patterns_mask("text"), F.lit(0)).alias("mask"))
    # equal queries are tokenised once: their first k ids stand for all
    same = Window.partitionBy("text", "sql").orderBy("eid")
    first = examples.where(F.col("eid").isNotNull()).withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k)
    tree = ClassTree(first.select("eid", token_set("text").alias("toks"), F.coalesce(sql_skeleton_mask("sql"), F.lit(0)).alias("mask")), k)
    found = top_k(q, tree, F.col("tok").isin(SIMILARITY_KEYWORDS), score)
    return found.select("qid", "rank", "eid", F.round("score", 6).alias("score"))


# ------------------------------------------------------------ near-duplicates

def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def token_sets(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, toks): distinct tokens of each whole text, written once because
    the similarity join reads them three times (document frequencies,
    prefixes, verification); ids must not repeat there."""
    return _written(df.select(F.col(id_col).alias("id"), tokens(text_col).alias("toks")), "token-sets")


def _hashes(toks) -> Column:
    return F.transform(_c(toks), lambda x: F.xxhash64(x))


def token_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal, non-empty token sets: members (row, id,
    class, copies), one per row of ``df``, and the classes' sets (id, toks),
    ``id`` being the class's number.

    A text copied a million times is a million members and one set.  Classes
    are numbered by size, from 450 tokens, and least token hash, so that alike
    sets have near numbers and are verified in the same blocks.
    """
    keyed = _written(spread(df.select("id", "text")).select("id", tokens("text").alias("toks"))
                     .select(F.monotonically_increasing_id().alias("row"), "id", F.unhex(F.sha2(F.array_join(F.array_sort("toks"), " "), 256)).alias("key"),
                             F.size("toks").alias("n"), F.array_min(_hashes("toks")).alias("low"), F.array_join("toks", " ").alias("words")), "token-sets").where("n > 0")
    # only rows and keys are grouped; a set travels once, as a text
    band = F.when(F.col("n") > 450, F.floor(F.log2("n") * 2)).otherwise(0)
    classes = keyed.groupBy("key").agg(F.min("row").alias("row"), F.min(band).alias("band"), F.min("low").alias("low"), F.count("*").alias("copies"))
    classes = _written(classes.orderBy("band", "low", "key").select(F.monotonically_increasing_id().alias("class"), "key", "row", "copies"), "token-classes")
    members = _written(keyed.select("row", "id", "key").join(classes.select("key", "class", "copies"), "key").select("row", "id", "class", "copies"), "token-members")
    own = broadcast_if_small(classes.select("row", F.col("class").alias("id")))
    sets = _written(keyed.select("row", "words").join(own, "row").select("id", "words"), "token-representatives")
    return members, sets.select("id", F.split("words", " ").alias("toks"))


def member_pairs(near: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(lid, rid, jaccard) of all pairs of rows whose classes are equal or near.

    ``near(lid, rid, jaccard)`` are pairs of classes, ``left`` and ``right``
    the members of ``token_classes``.  Within one table (``right`` is None)
    every pair of rows with different ids comes once, smaller id first.
    Members travel in lists of about 256; the pairs are made last and are not
    shuffled.
    """
    def lists(members: DataFrame, side: str) -> DataFrame:
        part = F.pmod(F.xxhash64("row"), F.ceil(F.col("copies") / 256))
        return members.groupBy(F.col("class").alias(f"{side}id"), part.alias(f"{side}part")).agg(F.collect_list(F.struct("id")).alias(side))

    if right is None:
        equal = left.where("copies > 1").select(F.col("class").alias("lid"), F.col("class").alias("rid"), F.lit(1.0).alias("jaccard")).distinct()
        near = near.unionByName(equal)
    other = left if right is None else right
    # the lists of a large class are met in as many tasks
    parts = other.where("copies > 256").select(F.col("class").alias("rid"), F.ceil(F.col("copies") / 256).alias("parts")).distinct()
    met = near.join(lists(left, "l"), "lid").join(parts, "rid", "left") \
        .withColumn("rpart", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).join(lists(other, "r"), ["rid", "rpart"])
    pairs = met.select((F.col("lid") == F.col("rid")).alias("same"), "jaccard", "r", F.explode("l").alias("a")).select("same", "jaccard", "a", F.explode("r").alias("b")) \
        .select("same", "jaccard", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    if right is not None:
        return pairs.select(F.col("a").alias("lid"), F.col("b").alias("rid"), "jaccard")
    once = F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return pairs.where(once).select(F.least("a", "b").alias("lid"), F.greatest("a", "b").alias("rid"), "jaccard")


# token hashes are counted in this many buckets: a table of bounded size, one byte a bucket
_RARITY_BUCKETS = 1 << 22


def token_rarity(*sets: DataFrame) -> np.ndarray:
    """Per bucket of token hashes its level, 8 * log2 of the sets' tokens in it
    (0: at most one), over the union of token-set frames — with the hash itself
    the global rarity order used by prefix filtering.  Any fixed order keeps
    the join exact; tokens that share a bucket only count as less rare."""
    src = None
    for x in sets:
        e = x.select(F.explode(_hashes("toks")).alias("h"))
        src = e if src is None else src.unionByName(e)
    counts = src.groupBy(F.col("h").bitwiseAND(F.lit(_RARITY_BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("df")).where("df > 1")
    got = counts.select("bucket", F.floor(F.log2("df") * 8).cast("int").alias("level")).toArrow()
    levels = np.zeros(_RARITY_BUCKETS, np.uint8)
    levels[got["bucket"].to_numpy()] = got["level"].to_numpy()
    return levels


# bits of a set's signature, in words of 64, and for sets of more than 450 tokens
_WORDS, _MORE_WORDS, _MORE_FROM = 4, 16, 450


def _slices(batch: pa.RecordBatch, tokens_each: int = 500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with a column ``h`` of lists: (part, sizes, row of each hash, hashes)."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("h")), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // tokens_each
    for first, last in zip(*[x.tolist() for x in (np.flatnonzero(np.diff(part, prepend=-1)), np.flatnonzero(np.diff(part, append=-1)) + 1)], strict=True):
        rows = batch.slice(first, last - first)
        yield rows, sizes[first:last], np.repeat(np.arange(last - first), sizes[first:last]), rows.column("h").flatten().to_numpy()


def _signatures(sets: DataFrame) -> DataFrame:
    """(id, h, s0, s1, ...): per set, its token hashes and 64 bits a word, each the parity of the tokens that hash to it.

    A token of one set only flips one bit, so two sets differ in at least as
    many tokens as their signatures differ in bits.  Few bits hardly tell large
    sets apart, so these have more (m0, m1, ..., null for others).
    """
    def parities(doc: np.ndarray, h: np.ndarray, rows: int, words: int) -> np.ndarray:
        bits, u = np.zeros(rows * words, np.uint64), h.view(np.uint64)
        np.bitwise_xor.at(bits, doc * words + (h & (words - 1)), np.uint64(1) << (u >> np.uint64(58)))
        return bits.view(np.int64).reshape(rows, words).T

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n, doc, h in _slices(batch):
                few, large = parities(doc, h, len(n), _WORDS), n > _MORE_FROM
                more = parities(doc[large[doc]], h[large[doc]], len(n), _MORE_WORDS)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, few), *[pa.array(x, mask=~large) for x in more]], names)

    names = ["id", "h", *[f"s{w}" for w in range(_WORDS)], *[f"m{w}" for w in range(_MORE_WORDS)]]
    schema = T.StructType([T.StructField("id", sets.schema["id"].dataType), T.StructField("h", T.ArrayType(T.LongType())), *[T.StructField(x, T.LongType()) for x in names[2:]]])
    return sets.select("id", _hashes("toks").alias("h")).mapInArrow(sign, schema)


def prefix_table(sets: DataFrame, rarity: np.ndarray, threshold: float, write: bool = True) -> DataFrame:
    """(id, n, pos, tok, p0, p1, signature): the first |s| - ceil(t*|s|) + 1 tokens
    of every set in rarity order, as hashes, with their 1-based position and
    the two tokens before them in this table.

    A token whose bucket holds no other set's token can be shared by no pair
    and has no row.
    """
    signed = _signatures(sets)
    bits = [x for x in signed.columns if x not in ("id", "h")]
    levels = sets.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n, doc, h in _slices(batch):
                level = levels.value[h & (_RARITY_BUCKETS - 1)]
                order = np.lexsort((h, level, doc))
                h, level = h[order], level[order]
                pos = np.arange(1, len(h) + 1) - np.repeat(np.cumsum(n) - n, n)
                kept = np.flatnonzero((pos <= (n - np.ceil(threshold * n - 1e-9) + 1)[doc]) & (level > 0))
                of, tok = doc[kept], h[kept]

                def before(k: int) -> pa.Array:
                    other = np.ones(len(of), bool)
                    other[k:] = of[k:] != of[:-k]
                    return pa.array(np.roll(tok, k), mask=other)  # noqa: B023

                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([rows.column("id").take(at), pa.array(n[of].astype(np.int32)), pa.array(pos[kept].astype(np.int32)), pa.array(tok),
                                                  before(1), before(2), *[rows.column(x).take(at) for x in bits]], names)

    names = ["id", "n", "pos", "tok", "p0", "p1", *bits]
    schema = T.StructType([T.StructField(x, sets.schema["id"].dataType if x == "id" else T.IntegerType() if x in ("n", "pos") else T.LongType()) for x in names])
    table = signed.mapInArrow(prefixes, schema)
    return _written(table, "prefixes") if write else table


def _block(key: str, like: DataFrame) -> Column:
    """The block of an id: 256 neighbouring numbers."""
    whole = isinstance(like.schema["id"].dataType, T.IntegralType)
    return F.shiftright(F.col(key).cast("long"), 8) if whole else F.pmod(F.xxhash64(key), F.lit(4096))


def _jaccard_in_blocks(pairs: DataFrame, lsets: DataFrame, rsets: DataFrame | None, threshold: float) -> DataFrame:
    """(lid, rid, jac) of the pairs with Jaccard >= threshold, from the whole sets.

    Pairs meet by the blocks of their ids: a set travels once to each pair of
    blocks that needs it, not once a pair, and a task holds two blocks of sets.
    """
    right = 0 if rsets is None else 1
    kind = lsets.schema["id"].dataType
    pairs = pairs.select(_block("lid", lsets).alias("lb"), _block("rid", lsets if rsets is None else rsets).alias("rb"), "lid", "rid")
    wanted = pairs.select("lb", "rb", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lid").alias("id")), F.struct(F.lit(right).alias("side"), F.col("rid").alias("id")))).alias("x")) \
        .select("lb", "rb", "x.side", "x.id").distinct()
    sets = lsets.select(F.lit(0).alias("side"), "id", F.array_join("toks", " ").alias("words"))
    if rsets is not None:
        sets = sets.unionByName(rsets.select(F.lit(1).alias("side"), "id", F.array_join("toks", " ").alias("words")))
    none = F.lit(None)
    rows = wanted.join(sets, ["side", "id"]).select("lb", "rb", "side", "id", none.cast(kind).alias("rid"), "words") \
        .unionByName(pairs.select("lb", "rb", F.lit(2).alias("side"), F.col("lid").alias("id"), "rid", none.cast("string").alias("words")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, codes = None, ({}, {}), {}
        for batch in batches:
            lb, rb, side = (batch.column(x).to_numpy() for x in ("lb", "rb", "side"))
            ids, rids, words = batch.column("id").to_pylist(), batch.column("rid").to_pylist(), batch.column("words")
            edges = np.flatnonzero((np.diff(lb) != 0) | (np.diff(rb) != 0) | (np.diff(side) != 0)) + 1
            out = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if (lb[a], rb[a]) != at:
                    at, found, codes = (lb[a], rb[a]), ({}, {}), {}
                if side[a] < 2:
                    for i, text in zip(ids[a:b], words.slice(a, b - a).to_pylist(), strict=True):
                        found[side[a]][i] = np.array([codes.setdefault(w, len(codes)) for w in text.split(" ")], np.int32)
                    continue
                marked, last = np.zeros(len(codes), bool), None
                for i, j in sorted(zip(ids[a:b], rids[a:b], strict=True)):
                    if i != last:
                        marked[:] = False
                        marked[found[0][i]] = True
                        last, size = i, len(found[0][i])
                    other = found[right][j]
                    both = int(np.count_nonzero(marked[other]))
                    jac = both / (size + len(other) - both)
                    if jac >= threshold:
                        out.append((i, j, jac))
            if out:
                kinds = batch.column("id").type, batch.column("rid").type, pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lid", "rid", "jac"])

    schema = T.StructType([T.StructField("lid", kind), T.StructField("rid", kind), T.StructField("jac", T.DoubleType())])
    return rows.repartition("lb", "rb").sortWithinPartitions("lb", "rb", "side").mapInArrow(compare, schema)


def _candidates(lpre: DataFrame, rpre: DataFrame | None, threshold: float) -> DataFrame:
    """(lid, rid) of the pairs that pass all filters of ``similar_pairs``, mostly once each.

    The prefix rows are dealt by token and sorted by size, so that a set only
    meets those of its token whose size fits; at most a million pairs at a time.
    """
    cross = rpre is not None
    rows = lpre.withColumn("side", F.lit(0))
    if rpre is not None:
        # tokens of both sides only
        rows = rows.join(broadcast_if_small(rpre.select("tok").distinct()), "tok", "left_semi").unionByName(rpre.withColumn("side", F.lit(1)))
    few, more = ([x for x in lpre.columns if x[0] == letter] for letter in "sm")
    share = threshold / (1 + threshold)

    def sizes(rows: pa.RecordBatch, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(rows that look for partners, index into others of their first, how many, first row to keep), others being the rows or the right ones."""
        tok, n, side = (rows.column(x).to_numpy().astype(np.int64) for x in ("tok", "n", "side"))
        group = np.cumsum(np.diff(tok, prepend=tok[:1]) != 0) << 32
        least = np.ceil(threshold * n - 1e-9).astype(np.int64)
        if cross:
            own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            keys = (group + n)[other]
            first = np.searchsorted(keys, (group + least)[own])
            last = np.searchsorted(keys, (group + np.floor(n / threshold + 1e-9).astype(np.int64))[own], "right")
            return own, first, last - first, int(np.searchsorted(group, group[-1]))
        own, keys = np.arange(new, len(tok)), group + n
        first = np.searchsorted(keys, (group + least)[new:])
        return own, first, own - first, int(np.searchsorted(keys, group[-1] + least[-1]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if kept is None else pa.concat_batches([kept, batch])
            own, first, many, keep = sizes(rows, 0 if kept is None else len(kept))
            col = {x: pc.fill_null(rows.column(x), 0).to_numpy() for x in rows.schema.names if x != "id"}
            other = np.flatnonzero(col["side"] == 1) if cross else None
            known = {x: rows.column(x).is_valid().to_numpy(zero_copy_only=False) for x in ("p0", "p1", "m0")}
            n, left = col["n"].astype(np.int64), col["n"].astype(np.int64) - col["pos"]
            part = (np.cumsum(many) - many) // 1_000_000
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:], strict=False):
                count = many[a:b]
                j = np.repeat(own[a:b], count)
                i = np.repeat(first[a:b] - (np.cumsum(count) - count), count) + np.arange(len(j))
                i = other[i] if cross else i
                need = np.ceil(share * (n[i] + n[j]) - 1e-9)
                ok = np.flatnonzero(1 + np.minimum(left[i], left[j]) >= need)
                i, j, most = i[ok], j[ok], n[i[ok]] + n[j[ok]] - 2 * need[ok]
                earlier = np.zeros(len(i), bool)
                for x in ("p0", "p1"):
                    for y in ("p0", "p1"):
                        earlier |= (col[x][i] == col[y][j]) & known[x][i] & known[y][j]
                apart = np.zeros(len(i), np.int64)
                for x in few:
                    apart += np.bitwise_count(col[x][i].view(np.uint64) ^ col[x][j].view(np.uint64))
                ok = np.flatnonzero(~earlier & (apart <= most))
                i, j, most = i[ok], j[ok], most[ok]
                large = np.flatnonzero(known["m0"][i] & known["m0"][j])
                apart = np.zeros(len(large), np.int64)
                for x in more:
                    apart += np.bitwise_count(col[x][i[large]].view(np.uint64) ^ col[x][j[large]].view(np.uint64))
                ok = np.ones(len(i), bool)
                ok[large] = apart <= most[large]
                if ok.any():
                    ids = [rows.column("id").take(pa.array(x[ok])) for x in (j, i)]
                    yield pa.RecordBatch.from_arrays(ids, ["lid", "rid"])
            # later rows of the last token may meet these: its right rows, or those not too small
            kept = rows.slice(keep)
            kept = kept.filter(pc.equal(kept.column("side"), 1)) if cross else kept

    kind = lpre.schema["id"].dataType
    met = rows.repartition("tok").sortWithinPartitions("tok", F.col("side").desc(), "n") \
        .mapInArrow(meet, T.StructType([T.StructField("lid", kind), T.StructField("rid", kind)]))
    return met if cross else met.where("lid <> rid").select(F.least("lid", "rid").alias("lid"), F.greatest("lid", "rid").alias("rid"))


def similar_pairs(lsets: DataFrame, lpre: DataFrame, rsets: DataFrame | None, rpre: DataFrame | None,
                  threshold: float) -> DataFrame:
    """Pairs with Jaccard >= threshold from prefix tables (self-join when
    ``rsets`` is None).  Filters, cheapest first, all where the prefixes of a
    token meet: length ratio, the positional bound at the pair's first shared
    token (all earlier tokens of both sets are unshared, so the overlap is at
    most 1 + min(n_l - i, n_r - j) and must reach t/(1+t) * (n_l + n_r)), no
    shared one among the two tokens before (the pair then has a row there as
    well), then the bits in which the sets' signatures differ; only survivors
    are made distinct and fetch their sets for the exact Jaccard."""
    pairs = _written(_candidates(lpre, rpre, threshold).distinct(), "candidates")
    return _jaccard_in_blocks(pairs, lsets, rsets, threshold).select("lid", "rid", F.round("jac", 6).alias("jaccard"))


def near_duplicate_pairs(left: DataFrame, right: DataFrame | None, threshold: float = 0.8,
                         tokenized: bool = False) -> DataFrame:
    """Exact set-similarity join: all pairs with token Jaccard >= threshold.

    ``left(id, text)`` (and ``right`` or a self-join when None), or
    ``(id, toks)`` frames from ``token_sets`` when ``tokenized``.  Prefix
    filtering over the global rarity order: two sets with Jaccard >= t must
    share a prefix token, so candidates come from an equi-join on prefix
    tokens (rare tokens: small groups), then length and positional filters
    and the exact Jaccard on the full sets.  Nothing is truncated.
    """
    if not tokenized:
        # equal texts collapse first; their pairs are made last
        (lm, Ls), (rm, Rs) = token_classes(left), (None, None) if right is None else token_classes(right)
        return member_pairs(near_duplicate_pairs(Ls, Rs, threshold, tokenized=True), lm, rm).where("lid is not null and rid is not null")
    if right is None:
        # the prefixes are read once
        return similar_pairs(left, prefix_table(left, token_rarity(left), threshold, write=False), None, None, threshold)
    rarity = token_rarity(left, right)
    return similar_pairs(left, prefix_table(left, rarity, threshold, write=False), right, prefix_table(right, rarity, threshold), threshold)


def later_near_copies(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Ids of the texts that have a near copy (token Jaccard >= threshold) with a smaller id.

    Texts with equal token sets collapse first and only classes enter the
    similarity join; a member is a later copy if its id is not the smallest
    of its class and all near ones, so a text copied a million times costs
    its rows, not their pairs.
    """
    members, sets = token_classes(df)
    near = near_duplicate_pairs(sets, None, threshold, tokenized=True)
    first = members.groupBy("class").agg(F.min("id").alias("first"))
    both = near.select(F.explode(F.array(F.struct(F.col("lid").alias("class"), F.col("rid").alias("of")), F.struct(F.col("rid").alias("class"), F.col("lid").alias("of")))).alias("x")).select("x.class", "x.of")
    least = both.join(first.withColumnRenamed("class", "of"), "of").select("class", "first").unionByName(first).groupBy("class").agg(F.min("first").alias("first"))
    return members.join(least, "class").where(F.col("id") > F.col("first")).select("id").distinct()

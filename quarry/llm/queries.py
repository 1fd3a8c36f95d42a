"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (chat, collocations, decontaminate, embedding_join, html_text, langid, ngram_join, packing, quality, rule_cascade, token_files,
                        url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# smallest id reachable over links (a, b) among nodes (id): label propagation in DuckDB
def _reach(nodes: str, links: str) -> str:
    return f"""
    both_ways AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})),
    reach(id, other) AS (SELECT id, id FROM ({nodes}) UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
    comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


# DuckDB twin of the word rules: A-Z lower-cased, then split
def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alnum_words(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@query("op1_embedding_near_dups", f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.95),
{_reach("SELECT vec_id AS id FROM embeddings", "SELECT a, b FROM links")},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN comp c ON c.id = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
""")
def op1_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at cosine 0.95 and their components."""
    return embedding_join.cosine_components(_table(spark, sf_dir, "embeddings"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label quality score of every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into bit-packed files and read them back."""
    return token_files.read_token_files(token_files.write_token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _url_oracle() -> str:
    weights = ", ".join(map(repr, url_filter.weights_plain(url_filter.default_labels())))
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

    def of(text, tag, n):
        return (f"list_transform(range(1, greatest(length({text}) - {n} + 1, 1) + 1), "
                f"lambda i: CAST(('0x' || substr(md5('{tag}' || substr({text}, i, {n})), 1, 6)) AS BIGINT) % {url_filter.BUCKETS})")
    grams = f"list_distinct(list_concat(list_concat({of('h', 'h', 3)}, {of('h', 'h', 4)}), list_concat({of('p', 'p', 3)}, {of('p', 'p', 4)})))"
    return f"""
WITH rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS t FROM pages),
parts AS (SELECT r, page_id, coalesce(translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(t, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(verdict, h, p) AS (VALUES {rules}),
fits AS (SELECT r, max_by(x.h || x.p, length(x.h || x.p)) AS rule, max_by(x.verdict, length(x.h || x.p)) AS verdict
  FROM parts JOIN rules x ON (host = x.h OR ends_with(host, '.' || x.h)) AND starts_with(path, x.p) GROUP BY r),
g AS (SELECT r, {grams} AS g FROM (SELECT r, '^' || host || '$' AS h, '^' || path || '$' AS p FROM parts)),
w AS (SELECT [{weights}] AS w),
scores AS (SELECT r, round(1 / (1 + exp(-(list_sum(list_transform(g, lambda b: w.w[b + 1])) + w.w[{url_filter.BUCKETS + 1}]) / sqrt(len(g)))), 6) AS score FROM g, w)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN s.score > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, s.score
FROM parts JOIN scores s USING (r) LEFT JOIN fits f USING (r)
"""


@query("op4_url_filter", _url_oracle())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then a logistic regression on hashed n-grams, for every page's url."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), None, URL_RULES)


@query("op5_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_alnum_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_alnum_words("text")} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, n, g FROM (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g
  FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT r, pos, x.n, item_id FROM doc_windows x JOIN item_windows y ON x.n = y.n AND x.g = y.g),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, array_agg(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside any benchmark window of ten words."""
    found = decontaminate.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by averaged subword embeddings."""
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


#: the tool that conversations are read as calls of
REPLY_SCHEMA = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
                          "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 6}, "context": {"type": "string"}}}}


@query("op8_tool_calls", """
WITH RECURSIVE parts AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
ids AS (SELECT DISTINCT conv_id, turn FROM parts WHERE role = 'user'),
answers AS (SELECT DISTINCT conv_id, turn FROM parts WHERE role = 'assistant'),
depths(conv_id, turn, depth) AS (
  SELECT conv_id, turn, 0 FROM ids i WHERE turn % 8 < 2 OR NOT EXISTS (SELECT 1 FROM ids p WHERE p.conv_id = i.conv_id AND p.turn = i.turn - 2)
  UNION ALL SELECT i.conv_id, i.turn, d.depth + 1 FROM depths d JOIN ids i ON i.conv_id = d.conv_id AND i.turn = d.turn + 2 WHERE i.turn % 8 >= 2),
items AS (
  SELECT p.conv_id, p.turn, p.text, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE coalesce(role, 'unknown') END AS role,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'c' || p.turn WHEN 'assistant' THEN 'c' || (p.turn - 1) END AS call_id,
    CASE WHEN role = 'assistant' AND i.turn IS NOT NULL THEN p.turn - 1 ELSE p.turn END AS anchor,
    CASE WHEN role = 'user' THEN own.depth WHEN role = 'assistant' THEN coalesce(d.depth, 0) ELSE 0 END AS depth,
    CASE WHEN role = 'user' OR (role = 'assistant' AND i.turn IS NOT NULL) THEN 1 ELSE 0 END AS place,
    CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS part,
    CASE WHEN role = 'user' AND (p.turn > 6 OR p.turn < 0 OR text = '') THEN 'invalid_arguments' WHEN role = 'user' AND p.turn % 8 >= 2 AND before.turn IS NULL THEN 'missing_dependency'
         WHEN role = 'user' AND a.turn IS NULL THEN 'unanswered' WHEN role = 'assistant' AND i.turn IS NULL THEN 'orphan_result' ELSE 'ok' END AS status
  FROM parts p LEFT JOIN ids i ON p.conv_id = i.conv_id AND i.turn = p.turn - 1 LEFT JOIN answers a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1
    LEFT JOIN ids before ON before.conv_id = p.conv_id AND before.turn = p.turn - 2
    LEFT JOIN depths own ON own.conv_id = p.conv_id AND own.turn = p.turn LEFT JOIN depths d ON d.conv_id = p.conv_id AND d.turn = p.turn - 1)
SELECT conv_id, turn, role, kind, call_id, anchor, CAST(depth AS INTEGER) AS depth, CAST(place AS INTEGER) AS place, CAST(part AS INTEGER) AS part, status,
  CASE kind
    WHEN 'call' THEN '{"role":"assistant",' || CASE WHEN status = 'ok' THEN '' ELSE '"status":"' || status || '",' END || '"tool_call":{"arguments":{'
      || CASE WHEN turn % 8 >= 2 THEN '"context":{"$result":"c' || (turn - 2) || '"},' ELSE '' END || '"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply"}}'
    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"role":"tool",' || CASE WHEN status = 'ok' THEN '' ELSE '"status":"' || status || '",' END || '"tool_call_id":"' || call_id || '"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' END AS json
FROM items
""")
def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as tool traffic: a user's turn is a call of ``reply``
    that uses the result of the user's turn before (of the same eight turns),
    the assistant's next turn is its result; linked, ordered, validated,
    serialised."""
    c = _table(spark, sf_dir, "conversations")
    context = F.when(F.col("turn") % 8 >= 2, F.struct(F.concat(F.lit("c"), F.col("turn") - 2).alias("$result")))
    call = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("c"), F.col("turn")).alias("id"), F.lit("reply").alias("name"),
        F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn", context.alias("context")).alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    traffic = c.select("conv_id", "turn",
                       F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))
    return chat.link_tool_calls(traffic, REPLY_SCHEMA)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op9_ngram_jaccard", f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingles),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
  AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 75
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{_reach("SELECT doc_id AS id FROM documents", "SELECT a, b FROM links")}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM shingles s JOIN comp c ON c.id = s.doc_id
""")
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 5-word shingles at Jaccard 0.75."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every vector."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def _quality_rules_sql() -> str:
    space = "\\x20\\x09-\\x0D"

    def share(count: str, of: str) -> str:
        return f"{count} / greatest({of}, 1)"

    def n_chars(kind: str) -> str:
        return f"length(regexp_replace(text, '[^{kind}]', '', 'g'))"

    def n_words(pattern: str) -> str:
        return f"len(list_filter(w, lambda x: regexp_matches(x, '{pattern}')))"

    def n_lines(pattern: str) -> str:
        return f"len(list_filter(ls, lambda x: regexp_matches(x, '{pattern}')))"

    rules = [share("n_symbols", "n") + " <= 0.1", share("word_chars", "n") + " BETWEEN 2 AND 16", share("n_dup_lines", "len(ls)") + " <= 0.5",
             share(n_chars("A-Z"), n_chars("A-Za-z")) + " <= 0.5", share(n_chars("0-9"), "word_chars") + " <= 0.5",
             share(n_words("[A-Za-z]|[^\\x00-\\x7F]"), "n") + " >= 0.5", share(n_words("[!-/:-@\\[-`{-~][!-/:-@\\[-`{-~]"), "n") + " <= 0.3",
             share("len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))", "n") + " <= 0.3", "len(list_distinct(w)) / sqrt(greatest(n, 1)) >= 1",
             share(n_lines(f"(\\.\\.\\.|…)[{space}]*$"), "len(ls)") + " <= 0.5", share(n_lines(f"^[{space}]*(\\* |- |• )"), "len(ls)") + " <= 0.95"]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[{space}]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM x WHERE len(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY r),
c AS (SELECT r, doc_id, text, w, ls, CAST(len(w) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST({n_chars("#*$%&|<>")} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM x LEFT JOIN repeated p USING (r))
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n < 10 OR 100 * n_repeat_words > 20 * n AS base_failed,
  NOT (n < 10 OR 100 * n_repeat_words > 20 * n) AND {" AND ".join(rules)} AS kept
FROM c
"""


@query("op12_quality_rules", _quality_rules_sql())
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the rule cascade for every document."""
    return rule_cascade.apply_rules(_table(spark, sf_dir, "documents")).drop("failed_rule", "rules_measured")


def _phrases(k: int) -> str:
    """Contiguous phrases of k words of the pieces' word lists ``p(lang, w)``."""
    return f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM p WHERE len(w) >= {k}"


def _cuts() -> str:
    """Every cut of every candidate."""
    return " UNION ALL ".join(f"SELECT lang, phrase, a, {c} AS cut, array_to_string(w[1:{c}], ' ') AS first, array_to_string(w[{c + 1}:{k}], ' ') AS rest FROM cand WHERE k = {k}"
                              for k in (2, 3, 4) for c in range(1, k))


def _inner() -> str:
    """Phrases of two or more words strictly inside a candidate."""
    return " UNION ALL ".join(f"SELECT lang, array_to_string(w[{i}:{i + m - 1}], ' ') AS phrase, a FROM cand WHERE k = {k}"
                              for k in (3, 4) for m in range(2, k) for i in range(1, k - m + 2))


@query("op11_phrase_collocations", f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({" UNION ALL ".join(_phrases(k) for k in (1, 2, 3, 4))}) GROUP BY lang, k, phrase HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((c.a::HUGEINT * 2000000) // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score
  FROM ({_cuts()}) c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM ({_inner()}) GROUP BY lang, phrase),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longest IS NULL OR 100 * g.longest < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language, found at least 30 times."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))

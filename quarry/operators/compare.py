"""Result-set comparison at scale (E ops).

Cells are compared by column expressions; row multisets by canonical row
keys aggregated into counts and full-joined, so two results of any size
are compared with one shuffle of (key, count) pairs instead of in a
Python loop.  Tolerant (non-transitive) matching runs in two phases:
exact canonical pairs first, then a blocked one-to-one matcher over the
residue only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import scratch_path

DEFAULT_RTOL = 1e-4
NULL_MARK = "␀"


def _num(c: Column) -> Column:
    """Number view of a cell: doubles as-is, numeric text parsed, else NULL."""
    return F.trim(c.cast("string")).try_cast("double")


def _is_null_or_nan(c: Column, is_float: bool) -> Column:
    return (c.isNull() | F.isnan(c)) if is_float else c.isNull()


def norm_text(c: Column) -> Column:
    """Lower-case, whitespace-collapsed, trimmed text."""
    return F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\s+", " ")


def eq_exact(a: Column, b: Column, a_float: bool = False, b_float: bool = False) -> Column:
    """Exact cell equality: NULL/NaN unify; numbers (incl. numeric text)
    compare as doubles; a NaN parsed from text never equals anything."""
    an, bn = _is_null_or_nan(a, a_float), _is_null_or_nan(b, b_float)
    af, bf = _num(a), _num(b)
    num_eq = F.when(F.isnan(af) | F.isnan(bf), F.lit(False)).otherwise(af == bf)
    return (F.when(an & bn, True).when(an | bn, False)
            .when(af.isNotNull() & bf.isNotNull(), num_eq)
            .otherwise(a.cast("string") == b.cast("string")))


def eq_semantic(a: Column, b: Column, rtol: float = DEFAULT_RTOL, a_float: bool = False,
                b_float: bool = False) -> Column:
    """Tolerant cell equality: |a-b| <= rtol*max(|a|,|b|,1), or one value
    100x the other (fraction vs percent); text compared case- and
    whitespace-insensitively."""
    an, bn = _is_null_or_nan(a, a_float), _is_null_or_nan(b, b_float)
    af, bf = _num(a), _num(b)
    scale = F.greatest(F.abs(af), F.abs(bf), F.lit(1.0))
    r = F.try_divide(af, bf)
    close = (F.abs(af - bf) <= F.lit(rtol) * scale) | (
        (af != 0) & (bf != 0) & ((F.abs(r - 100.0) <= 0.01) | (F.abs(r - 0.01) <= 0.0001)))
    num_eq = (F.when(F.isnan(af) & F.isnan(bf), True).when(F.isnan(af) | F.isnan(bf), False)
              .when(F.abs(af) == float("inf"), af == bf).when(F.abs(bf) == float("inf"), F.lit(False))
              .otherwise(close))
    return (F.when(an & bn, True).when(an | bn, False)
            .when(af.isNotNull() & bf.isNotNull(), num_eq)
            .otherwise(norm_text(a) == norm_text(b)))


def canonical_cell(c: Column, is_float: bool = False, is_number: bool = False) -> Column:
    """Text form under which exactly-equal cells coincide; typed numbers are not parsed."""
    if is_number:
        x = c.cast("double") + F.lit(0.0)  # -0.0 becomes 0.0
        return F.when(_is_null_or_nan(c, is_float), F.lit(NULL_MARK)).otherwise(F.concat(F.lit("n:"), x.cast("string")))
    nan_or_null = _is_null_or_nan(c, is_float)
    num = _num(c)
    return (F.when(nan_or_null, F.lit(NULL_MARK))
            .when(num.isNotNull() & ~F.isnan(num), F.concat(F.lit("n:"), num.cast("string")))
            .otherwise(F.concat(F.lit("s:"), c.cast("string"))))


def float_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}


def with_row_key(df: DataFrame, name: str = "_rk") -> DataFrame:
    """Canonical row key: two independent 64-bit xxhash values of the
    canonical row text (a 128-bit key; cheaper per row than a SHA digest,
    collisions ~2^-128), as 16 bytes, since keys are what is shuffled and
    written most."""
    fc = float_cols(df)
    num = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    text = F.concat_ws("␟", *[canonical_cell(F.col(c), c in fc, c in num) for c in df.columns])
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("#"), text))]
    return df.withColumn(name, F.unhex(F.concat(*halves)))


def key_counts(df: DataFrame) -> DataFrame:
    return with_row_key(df).groupBy("_rk").agg(F.count("*").alias("_n"))


def multiset_compare(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Unordered exact comparison.  One row:
    gold_rows, pred_rows, matched_rows, missing_rows, extra_rows, match, partial_score."""
    g = key_counts(gold).withColumnRenamed("_n", "_g")
    p = key_counts(pred).withColumnRenamed("_n", "_p")
    j = g.join(p, "_rk", "full_outer").fillna(0, ["_g", "_p"])
    agg = j.agg(F.sum("_g").alias("gold_rows"), F.sum("_p").alias("pred_rows"),
                F.sum(F.least("_g", "_p")).alias("matched_rows"),
                F.sum(F.greatest(F.col("_g") - F.col("_p"), F.lit(0))).alias("missing_rows"),
                F.sum(F.greatest(F.col("_p") - F.col("_g"), F.lit(0))).alias("extra_rows"))
    agg = agg.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                       for c in ["gold_rows", "pred_rows", "matched_rows", "missing_rows", "extra_rows"]])
    return agg.select("*", ((F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)).alias("match"),
                      partial_score(F.col("matched_rows"), F.col("gold_rows"), F.col("pred_rows")).alias("partial_score"))


def partial_score(matched: Column, gold_rows: Column, pred_rows: Column) -> Column:
    """matched / gold rows; empty gold scores 1 when pred is empty too, else 0."""
    return F.round(F.when(gold_rows == 0, F.when(pred_rows == 0, 1.0).otherwise(0.0))
                   .otherwise(matched.cast("double") / gold_rows.cast("double")), 6)


def ordered_compare(gold: DataFrame, pred: DataFrame, pos: str = "pos") -> DataFrame:
    """Ordered exact match.  Both sides carry a 1-based position column;
    rows are full-joined on position and every cell must be exactly equal."""
    cols = [c for c in gold.columns if c != pos]
    gf, pf = float_cols(gold), float_cols(pred)
    g = gold.select(F.col(pos), F.lit(1).alias("_gi"), *[F.col(c).alias(f"g_{c}") for c in cols])
    p = pred.select(F.col(pos), F.lit(1).alias("_pi"), *[F.col(c).alias(f"p_{c}") for c in cols])
    j = g.join(p, pos, "full_outer")
    same = F.col("_gi").isNotNull() & F.col("_pi").isNotNull()
    for c in cols:
        same = same & eq_exact(F.col(f"g_{c}"), F.col(f"p_{c}"), c in gf, c in pf)
    hit = F.when(same, 1).otherwise(0)
    a = j.agg(F.count("_gi").alias("gold_rows"), F.count("_pi").alias("pred_rows"),
              F.coalesce(F.sum(hit), F.lit(0)).alias("position_hits"))
    return a.select("*", ((F.col("position_hits") == F.col("gold_rows")) & (F.col("gold_rows") == F.col("pred_rows")))
                    .alias("ordered_match"),
                    partial_score(F.col("position_hits"), F.col("gold_rows"), F.col("pred_rows")).alias("partial_score"))


def keyed_mismatch_counts(gold: DataFrame, pred: DataFrame, keys: Sequence[str], semantic: bool,
                          rtol: float = DEFAULT_RTOL) -> DataFrame:
    """Per-column mismatch counts of two tables keyed by ``keys``;
    rows present on one side only count as mismatches in every column."""
    cols = [c for c in gold.columns if c not in keys]
    gf, pf = float_cols(gold), float_cols(pred)
    g = gold.select(*keys, *[F.col(c).alias(f"g_{c}") for c in cols], F.lit(1).alias("_gi"))
    p = pred.select(*keys, *[F.col(c).alias(f"p_{c}") for c in cols], F.lit(1).alias("_pi"))
    j = g.join(p, list(keys), "full_outer")
    both = F.col("_gi").isNotNull() & F.col("_pi").isNotNull()
    out = [F.count("*").alias("n_keys")]
    for c in cols:
        eq = (eq_semantic(F.col(f"g_{c}"), F.col(f"p_{c}"), rtol, c in gf, c in pf) if semantic
              else eq_exact(F.col(f"g_{c}"), F.col(f"p_{c}"), c in gf, c in pf))
        out.append(F.count_if(~(both & eq)).alias(f"{c}_mismatches"))
    return j.agg(*out)


# ---------------------------------------------------------------- tolerant


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _added(flow: DataFrame, more: DataFrame) -> DataFrame:
    """Sum of two flows (g, p, f), without the pairs that cancel out."""
    return _written(flow.unionByName(more).groupBy("g", "p").agg(F.sum("f").alias("f")).where("f > 0"), "match-flow")


def _open(nodes: DataFrame, flow: DataFrame, side: str) -> DataFrame:
    """Nodes (side, n) with copies that the flow leaves unmatched: (side, slack)."""
    used = flow.groupBy(side).agg(F.sum("f").alias("_used"))
    return (nodes.join(used, side, "left").select(side, (F.col("n") - F.coalesce("_used", F.lit(0))).alias("slack")).where("slack > 0"))


def _split(rows: DataFrame, by: str, want: str, limit: str, seed: int) -> DataFrame:
    """``rows`` with ``want`` cut down so that its sum per ``by`` is at most ``limit``, and exactly that if they want more.

    Rows are served in the order of a hash, first in up to 1,024 parts of a
    group, then inside each part, so that a row with very many pairs is not
    sorted in one task.
    """
    h = F.xxhash64(F.lit(seed), "g", "p")
    rows = rows.withColumn("_part", F.pmod(h, F.lit(1024)))
    parts = rows.groupBy(by, "_part").agg(F.sum(want).alias("_want"), F.first(limit).alias("_limit"))
    upto = F.sum("_want").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = parts.select(by, "_part", F.least("_want", F.col("_limit") - (upto - F.col("_want"))).alias("_share")).where("_share > 0")
    own = Window.partitionBy(by, "_part").orderBy(h, "g", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.least(F.col(want), F.col("_share") - (F.sum(want).over(own) - F.col(want)))
    return rows.join(share, [by, "_part"]).withColumn("_got", got).where("_got > 0").withColumn(want, F.col("_got")).drop("_part", "_share", "_got")


def maximum_matching(gold: DataFrame, pred: DataFrame, flow: DataFrame, edges_of) -> DataFrame:
    """A maximum one-to-one matching between copies of distinct rows.

    ``gold(g, n)`` and ``pred(p, n)`` are distinct rows with their numbers of
    copies, ``flow(g, p, f)`` a first matching, ``edges_of(golds)`` the pairs
    (g, p) of some gold rows (a table ``g``).  Returns (g, p, f): f copies of
    g matched with copies of p.

    First, open copies on both sides are matched directly in rounds: a gold
    row offers its copies to its open partners one after the other, a
    predicted row takes as many of what it is offered as it has.  Then augmenting paths:
    all open gold rows search breadth-first at once, and copies are sent along
    the layers found (``_augment``).  The matching is maximum when no search
    reaches an open predicted row.  Pairs are looked up for gold rows that a search
    reaches, not for those that have their exact partner and are never met.
    """
    flow = _written(flow, "match-flow")
    known: DataFrame | None = None  # pairs of the gold rows looked up so far
    asked: DataFrame | None = None

    def pairs_of(golds: DataFrame) -> DataFrame:
        nonlocal known, asked
        new = golds.select("g") if asked is None else golds.select("g").join(asked, "g", "left_anti")
        new = _written(new.distinct(), "match-golds")
        if not new.isEmpty():
            found = _written(edges_of(new).select("g", "p").distinct(), "match-pairs")
            known = found if known is None else known.unionByName(found)
            asked = new if asked is None else asked.unionByName(new)
        return known

    for turn in range(1 << 30):  # every turn adds to the flow or ends
        left = _written(_open(gold, flow, "g").select("g", F.lit(None).cast(pred.schema["p"].dataType).alias("p"), "slack")
                        .unionByName(_open(pred, flow, "p").select(F.lit(None).cast(gold.schema["g"].dataType).alias("g"), "p", "slack")), "match-open")
        roots, sinks = left.where("g is not null").select("g", "slack"), left.where("p is not null").select("p", "slack")
        some = left.agg(F.count("g"), F.count("p")).first()
        if not some[0] or not some[1]:
            return flow
        pairs = pairs_of(roots) if known is None else known  # the open gold rows only become fewer
        direct = _written(pairs.join(roots.withColumnRenamed("slack", "sg"), "g").join(sinks.withColumnRenamed("slack", "sp"), "p")
                          .withColumn("f", F.least("sg", "sp")), "match-direct")
        if not direct.isEmpty():
            offered = _written(_split(direct, "g", "f", "sg", turn), "match-offered")
            flow = _added(flow, _split(offered, "p", "f", "sp", turn).select("g", "p", "f"))
            continue
        more = _augment(roots, sinks, flow, pairs, pairs_of, turn)
        if more is None:
            return flow
        flow = _added(flow, more)
    raise AssertionError("unreachable")


def _augment(roots: DataFrame, sinks: DataFrame, flow: DataFrame, pairs: DataFrame, pairs_of, turn: int) -> DataFrame | None:
    """Changes of the flow along shortest augmenting paths; None if no path is left.

    A breadth-first search from all open gold rows gives layers: from gold to
    predicted rows along pairs, from these to the gold rows they are matched
    with, and so on up to the first layer with open predicted rows.  From
    there back, each row learns how many copies can get through it at most;
    then copies are sent forward, split within these bounds; and what did not
    get through is taken back from the end.  Many copies can share a row.
    """
    to_pred: list[DataFrame] = []  # (g, p) into a layer of predicted rows
    to_gold: list[DataFrame] = []  # (g, p, f) into a layer of gold rows
    frontier = seen_g = roots.select("g")
    seen_p = None
    while True:
        step = (pairs if not to_gold else pairs_of(frontier)).join(frontier, "g", "left_semi").select("g", "p")
        layer = _written(step if seen_p is None else step.join(seen_p, "p", "left_anti"), "match-layer-p")
        if layer.isEmpty():
            return None
        to_pred.append(layer)
        reached = layer.select("p").distinct()
        seen_p = reached if seen_p is None else seen_p.unionByName(reached)
        ends = _written(reached.join(sinks, "p").select("p", F.col("slack").alias("most")), "match-ends")
        if not ends.isEmpty():
            break
        back = _written(flow.join(reached, "p", "left_semi").join(seen_g, "g", "left_anti"), "match-layer-g")
        if back.isEmpty():
            return None
        to_gold.append(back)
        frontier = back.select("g").distinct()
        seen_g = seen_g.unionByName(frontier)

    depth, most_p = len(to_pred), ends
    for i in range(depth - 1, -1, -1):
        to_pred[i] = _written(to_pred[i].join(most_p, "p"), "match-live-p")  # g, p, most: copies that can go on from p
        if i:
            most_g = to_pred[i].groupBy("g").agg(F.sum("most").alias("_most"))
            to_gold[i - 1] = _written(to_gold[i - 1].join(most_g, "g").select("g", "p", F.least("f", "_most").alias("most")), "match-live-g")
            most_p = to_gold[i - 1].groupBy("p").agg(F.sum("most").alias("most"))

    supply = roots.select("g", F.col("slack").alias("have"))
    for i in range(depth):
        offers = _split(to_pred[i].join(supply, "g").withColumn("f", F.least("have", "most")), "g", "f", "have", turn)
        to_pred[i] = _written(_split(offers, "p", "f", "most", turn).select("g", "p", "f"), "match-sent-p")
        if i + 1 < depth:
            arrived = to_pred[i].groupBy("p").agg(F.sum("f").alias("have"))
            sent = _split(to_gold[i].join(arrived, "p").withColumn("f", F.least("have", "most")), "p", "f", "have", turn)
            to_gold[i] = _written(sent.select("g", "p", "f"), "match-sent-g")
            supply = to_gold[i].groupBy("g").agg(F.sum("f").alias("have"))

    change = to_pred[-1]
    for i in range(depth - 2, -1, -1):
        need = to_pred[i + 1].groupBy("g").agg(F.sum("f").alias("_need"))
        to_gold[i] = _written(_split(to_gold[i].join(need, "g"), "g", "f", "_need", turn).select("g", "p", "f"), "match-kept-g")
        need = to_gold[i].groupBy("p").agg(F.sum("f").alias("_need"))
        to_pred[i] = _written(_split(to_pred[i].join(need, "p"), "p", "f", "_need", turn).select("g", "p", "f"), "match-kept-p")
        change = change.unionByName(to_gold[i].withColumn("f", -F.col("f"))).unionByName(to_pred[i])
    return change


def tolerant_compare(gold: DataFrame, pred: DataFrame, rtol: float = DEFAULT_RTOL) -> DataFrame:
    """Unordered tolerant match, one verdict row.

    Equal rows collapse to one row with a count on each side, and exactly
    equal rows (canonical key) are matched first.  Tolerant pairs of the rest
    come from a join on blocks: the normalised text cells plus an ``asinh``
    bucket of the first floating cell (each gold row also asks the
    neighbouring buckets and the x100 and x0.01 buckets, so every tolerant
    partner shares a block), filtered by the cell rule.  ``maximum_matching``
    then gives the largest one-to-one matching there is, undoing exact pairs
    where that lets more rows match.
    """
    cols = gold.columns
    pred = pred.select(*[F.col(pc).alias(gc) for pc, gc in zip(pred.columns, cols)])
    gf, pf = float_cols(gold), float_cols(pred)
    text_cols = [c for c in cols if c not in gf and c not in pf]
    whole = {f.name for f in gold.schema.fields if isinstance(f.dataType, T.IntegralType)}
    num_cols = [c for c in cols if c in gf or c in pf] or [c for c in cols if c in whole]

    def distinct_rows(df: DataFrame, side: str) -> DataFrame:
        # rows of one canonical key are equal for the cell rule as well: any of them stands for all
        rows = with_row_key(df).groupBy("_rk").agg(F.count("*").alias("n"), *[F.first(c).alias(f"{side}_{c}") for c in cols])
        return _written(rows.withColumnRenamed("_rk", side), f"compare-{side}")

    g, p = distinct_rows(gold, "g"), distinct_rows(pred, "p")

    def block_text(side: str) -> Column:
        if not text_cols:
            return F.lit("")
        return F.concat_ws("␟", *[F.when(_num(F.col(f"{side}_{c}")).isNotNull(), F.lit("#"))
                                       .otherwise(F.coalesce(norm_text(F.col(f"{side}_{c}")), F.lit(NULL_MARK)))
                                  for c in text_cols])

    def bucket(x: Column) -> Column:
        # NULL and NaN are one block, each infinity another
        inf = float("inf")
        return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).when(x == inf, F.lit(2**62)).when(x == -inf, F.lit(-(2**62)))
                .otherwise(F.floor(F.asinh(x) / F.lit(2 * rtol))))

    def blocked(df: DataFrame, side: str, buckets: Column) -> DataFrame:
        return (df.withColumn("_b", buckets).withColumn("_blk", F.concat_ws("|", block_text(side), F.coalesce(F.col("_b").cast("string"), F.lit("n")))).drop("_b", "n"))

    ok = F.lit(True)
    for c in cols:
        ok = ok & eq_semantic(F.col(f"g_{c}"), F.col(f"p_{c}"), rtol, c in gf, c in pf)

    def edges_of(golds: DataFrame) -> DataFrame:
        asked = g.join(golds, "g", "left_semi")
        if num_cols:
            x, y = _num(F.col(f"g_{num_cols[0]}")), _num(F.col(f"p_{num_cols[0]}"))
            near = F.explode(F.array_distinct(F.array(*[bucket(x * m) + d for m in (1.0, 100.0, 0.01) for d in (-1, 0, 1)])))
            left, right = blocked(asked, "g", near), blocked(p, "p", bucket(y))
        else:
            left, right = blocked(asked, "g", F.lit(0)), blocked(p, "p", F.lit(0))
        return left.join(right, "_blk").where(ok)

    gn, pn = g.select("g", "n"), p.select("p", "n")
    exact = gn.withColumnRenamed("n", "_a").join(pn.withColumnRenamed("n", "_b"), F.col("g") == F.col("p")).select("g", "p", F.least("_a", "_b").alias("f"))
    flow = maximum_matching(gn, pn, exact, edges_of)
    zero = F.lit(0).cast("bigint")
    v = (gn.agg(F.coalesce(F.sum("n"), zero).alias("gold_rows")).crossJoin(pn.agg(F.coalesce(F.sum("n"), zero).alias("pred_rows")))
         .crossJoin(flow.agg(F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("f"))), zero).alias("matched_exact"), F.coalesce(F.sum("f"), zero).alias("_m"))))
    m = F.col("_m")
    return v.select("gold_rows", "pred_rows", "matched_exact", (m - F.col("matched_exact")).alias("matched_tolerant"),
                    (F.col("gold_rows") - m).alias("unmatched_gold"), (F.col("pred_rows") - m).alias("unmatched_pred"),
                    ((F.col("gold_rows") == m) & (F.col("pred_rows") == m)).alias("match"),
                    (F.col("gold_rows") == m).alias("superset_match"),
                    partial_score(m, F.col("gold_rows"), F.col("pred_rows")).alias("partial_score"))


# ---------------------------------------------------------------- alignment


def align_columns(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Project both results onto their shared columns, in gold's order.

    Works on the two schemas only (a handful of strings on the driver):
    the first predicted column of the same case-blind name, else one whose
    name contains or is contained in the gold name, closest in length.
    Gold columns without a partner leave *both* sides; None without any
    shared column.  The data is never collected; each side is one ``select``.
    """
    pcols = list(pred.columns)
    used: set[str] = set()
    pairs: list[tuple[str, str]] = []
    for gcol in gold.columns:
        gl = gcol.lower()
        hit = next((p for p in pcols if p.lower() == gl), None)
        if hit is None or hit in used:
            cands = [p for p in pcols if p not in used and (gl in p.lower() or p.lower() in gl)]
            hit = min(cands, key=lambda p: (abs(len(p) - len(gcol)), pcols.index(p)), default=None)
        if hit is not None:
            used.add(hit)
            pairs.append((gcol, hit))
    if not pairs:
        return None
    return gold.select(*[F.col(g) for g, _ in pairs]), pred.select(*[F.col(p).alias(g) for g, p in pairs])


def result_fingerprint(df: DataFrame, group: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """Order-free fingerprint of each result set (rows grouped by
    ``group``): row count, sum of 32-bit row hashes and xor of 60-bit row
    hashes, every row hash an md5 of the '|'-joined cell text."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(NULL_MARK)) for c in cells]))
    d = df.select(*group, F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").alias("_h32"),
                  F.conv(F.substring(h, 9, 15), 16, 10).cast("bigint").alias("_h60"))
    return d.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sum("_h32").alias("fp_sum"),
                                 F.bit_xor("_h60").alias("fp_xor"))

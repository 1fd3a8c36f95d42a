"""N-gram Jaccard self-join by vertical partitioning (operator 9).

Every document is the set of its distinct n-word shingles (64-bit hashes).
The global n-gram order is cut into ``fragments``; the overlap of a
candidate pair is counted in each fragment on its own and the partial
counts are summed per pair, so one long set never meets another in one
task and a hot document is split over its fragments.

Steps, each a Spark job over all rows:

1. ``sets``: size, set key and a few min-hashes per document, and the
   shingles seen repeatedly inside a task (a Misra-Gries style summary,
   used only to order n-grams).  Equal sets collapse to one class.
2. Star candidates: classes that share a min-hash are compared with the
   smallest class of the bucket, which is linear in the bucket.  Verified
   links are contracted to components.
3. Prefix candidates make the join exact: two linked sets share an n-gram
   of their prefixes in any global order.  Only n-grams whose postings hold
   more than one component matter, so a group of copies that step 2 has
   joined costs nothing here; the largest component of a posting is never
   paired with itself.
4. Vertical verification, contraction, membership of every document.

Nulls, empty texts and texts without words have an empty set and link with
nothing.  Rows with a null ``doc_id`` are returned with a null component
and link nothing.  Repeated rows are equal sets; ``doc_id`` names a document,
so rows that share it and differ in text link as one.  Extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.spans import SPACE_WORDS, mix, runs_of, sub_batches, words_of
from quarry.session import scratch_path

#: the repeated n-grams, ordered by how often, behind all others; at most this many are shipped to tasks (9 bytes each)
HOT_LIMIT = 1 << 20
#: n-grams in the repeated-shingle summary kept per task before it is pruned by one count
SUMMARY_LIMIT = 1 << 20
#: tables of ids up to this many rows (about 30 bytes each) are broadcast, so that texts stay in place; larger ones are shuffled
BROADCAST_ROWS = 2_000_000
_SEEDS = np.array([0x1234567, 0x9ABCDEF1, 0x55AA55AA5, 0xF00DF00D7], dtype=np.uint64)


def shingle_sets(texts, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, sorted distinct shingle hashes) of every text (bytes or None)."""
    for first, last in sub_batches(texts):
        words, at = words_of(texts[first:last], SPACE_WORDS)
        runs = runs_of(words, n)
        for i in range(last - first):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                yield first + i, np.unique(runs[a:b - n + 1])
            elif b > a:  # fewer words than n: the whole sequence is one shingle
                whole = mix(np.array([b - a], dtype=np.uint64))
                for w in words[a:b]:
                    whole = mix(whole * np.uint64(31) + w)
                yield first + i, whole
            else:
                yield first + i, np.zeros(0, dtype=np.uint64)


def prefix_size(n: int, num: int, den: int) -> int:
    """Elements of a set of ``n`` that any linked set must share one of."""
    return n - -(-n * num // den) + 1


def broadcast_if_small(df: DataFrame, written: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if ``written``, a written table with at least its rows, is checked to be small."""
    return F.broadcast(df) if written.count() <= BROADCAST_ROWS else df


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _summarise(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # n-grams met in more than one distinct set of this task, by their counts
        once: set[int] = set()
        hot_h, hot_c, pending, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def fold():
            nonlocal hot_h, hot_c, pending, size
            if not pending:
                return
            h, c = np.unique(np.concatenate([hot_h, *pending]), return_inverse=True)
            count = np.bincount(c, weights=np.concatenate([hot_c, np.ones(len(c) - len(hot_h))]), minlength=len(h)).astype(np.int64)
            if len(h) > SUMMARY_LIMIT:  # Misra-Gries: everyone loses a count, single ones leave
                count -= 1
                h, count = h[count > 0], count[count > 0]
                while len(h) > SUMMARY_LIMIT:
                    count -= 1
                    h, count = h[count > 0], count[count > 0]
            hot_h, hot_c, pending, size = h, count, [], 0

        for pdf in batches:
            ids, ns, keys, sigs = [], [], [], []
            for i, s in shingle_sets(pdf["text"].tolist(), n):
                ids.append(pdf["doc_id"].iloc[i])
                ns.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    continue
                k1, k2 = int(np.bitwise_xor.reduce(mix(s * np.uint64(3)))), int(np.add.reduce(mix(s + _SEEDS[0])))
                key = k1.to_bytes(8, "little") + k2.to_bytes(8, "little") + len(s).to_bytes(4, "little")
                keys.append(key)
                sigs.append([int(np.min(mix(s ^ seed)).astype(np.int64)) for seed in _SEEDS])
                if hash(key) not in once:
                    if len(once) > 2_000_000:
                        once.clear()
                    once.add(hash(key))
                    pending.append(s)
                    size += len(s)
                    if size > 2 * SUMMARY_LIMIT:
                        fold()
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": ns, "set_key": keys, "sigs": sigs, "hot": None, "hot_count": None})
        fold()
        h, c = hot_h[hot_c > 1], hot_c[hot_c > 1]
        for i in range(0, len(h), 20_000):
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": [-1], "set_key": [None], "sigs": [None],
                                "hot": [h[i:i + 20_000].view(np.int64).tolist()], "hot_count": [c[i:i + 20_000].tolist()]})
    return run


def _hot_ngrams(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Most repeated n-grams, at most ``HOT_LIMIT`` (a bounded table), sorted by hash, and the binary logarithm of their counts."""
    counts = (summary.where("n = -1").select(F.explode(F.arrays_zip("hot", "hot_count")).alias("x"))
              .groupBy(F.col("x.hot").alias("h")).agg(F.sum("x.hot_count").alias("c")))
    rows = counts.orderBy(F.desc("c"), "h").limit(HOT_LIMIT).select("h", F.floor(F.log2("c")).cast("byte").alias("c")).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(np.uint8)[order]


def _prefixes(n: int, num: int, den: int, hot):
    """doc_id, comp, text -> doc_id, comp, size and the prefix in the order (repetition, hash)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, level = hot.value
        for pdf in batches:
            for first, last in sub_batches(pdf["text"].tolist()):
                part = pdf.iloc[first:last]
                size, pre = [], []
                for _, s in shingle_sets(part["text"].tolist(), n):
                    p = prefix_size(len(s), num, den) if len(s) else 0
                    if len(frequent) and p:
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s2 = s[np.argsort(np.where(frequent[at] == s, level[at] + 1, 0), kind="stable")[:p]]
                    else:
                        s2 = s[:p]
                    size.append(len(s))
                    pre.append(s2.view(np.int64))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "comp": part["comp"].array, "n": size, "grams": pre})
    return run


def _segments(n: int, fragments: int, names: list[str]):
    """doc_id, text -> one row per fragment of the document's set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last in sub_batches(pdf["text"].tolist()):
                part = pdf.iloc[first:last]
                ids, frag, size, seg = [], [], [], []
                for i, s in shingle_sets(part["text"].tolist(), n):
                    cut = np.searchsorted(s, (np.arange(1, fragments, dtype=np.uint64) * np.uint64((1 << 64) // fragments)))
                    for f, x in enumerate(np.split(s, cut)):
                        if len(x):
                            ids.append(part["doc_id"].iloc[i])
                            frag.append(f)
                            size.append(len(s))
                            seg.append(x.tobytes())
                yield pd.DataFrame({"doc_id": ids, "frag": frag, "n": size, "seg": seg}).set_axis(names, axis=1)
    return run


def _partial_overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) if x != y else len(x) // 8
             for x, y in zip(pdf["seg_a"], pdf["seg_b"])]
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "frag": pdf["frag"], "n_a": pdf["n_a"], "n_b": pdf["n_b"], "overlap": c})


def vertical_overlaps(pairs: DataFrame, src: DataFrame, n: int, fragments: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of candidate pairs by partial counts per fragment.

    ``pairs`` has distinct (a, b).  Pairs whose sets share nothing are absent.
    """
    def segments(side: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("doc_id")).distinct()
        return (src.join(broadcast_if_small(ids, pairs), "doc_id", "left_semi").select("doc_id", "text")
                .mapInPandas(_segments(n, fragments, [side, "frag", f"n_{side}", f"seg_{side}"]), f"{side} long, frag int, n_{side} int, seg_{side} binary"))

    # b's segments travel once, to a's of the same fragment
    both = segments("b").join(broadcast_if_small(pairs, pairs), "b").join(segments("a"), ["a", "frag"])
    parts = both.select("a", "b", "frag", "n_a", "n_b", "seg_a", "seg_b").mapInPandas(
        _partial_overlap, "a long, b long, frag int, n_a int, n_b int, overlap long")
    # repeated rows of one doc_id give a fragment's count more than once
    return (parts.groupBy("a", "b", "n_a", "n_b", "frag").agg(F.max("overlap").alias("overlap"))
            .groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap")))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, fragments: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (see the module's text).

    Documents link when ``den * intersection >= num * union``; the
    component is the smallest doc_id reachable, the document's own included.
    """
    spark = docs.sparkSession
    src = _source(docs)
    path = scratch_path(spark, "ngram-sets")
    src.mapInPandas(_summarise(n), "doc_id long, n long, set_key binary, sigs array<long>, hot array<long>, hot_count array<long>").write.parquet(path)
    summary = spark.read.parquet(path)
    sets = summary.where("n >= 0")

    # classes of equal sets; the representative is the smallest id
    classes = (sets.where("set_key is not null and doc_id is not null").groupBy("set_key", "n")
               .agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs")))
    class_path = scratch_path(spark, "ngram-classes")
    classes.write.parquet(class_path)
    classes = spark.read.parquet(class_path)

    # star candidates: smallest class of each min-hash bucket
    sig = classes.select("rep", "n", F.posexplode("sigs").alias("k", "h"))
    hub = sig.groupBy("k", "h").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    stars = (sig.join(hub, ["k", "h"]).where("rep <> hub.rep")
             .where(F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num)
             .select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct())
    links = _verified(stars, src, n, num, den, fragments, spark, "ngram-stars")
    comps = connected_components(links)

    # prefix candidates across components
    reps = (classes.select(F.col("rep").alias("doc_id")).join(comps, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", F.coalesce("component", "doc_id").alias("comp")))
    hot = spark.sparkContext.broadcast(_hot_ngrams(summary))
    path = scratch_path(spark, "ngram-reps")
    reps.write.parquet(path)
    reps = spark.read.parquet(path)
    post = (src.join(broadcast_if_small(reps, reps), "doc_id").select("doc_id", "comp", "text")
            .mapInPandas(_prefixes(n, num, den, hot), "doc_id long, comp long, n int, grams array<long>")
            .select("doc_id", "comp", "n", F.posexplode("grams").alias("at", "g")))
    post_path = scratch_path(spark, "ngram-postings")
    post.write.parquet(post_path)
    post = spark.read.parquet(post_path)
    path = scratch_path(spark, "ngram-mixed")
    post.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g").write.parquet(path)
    mixed = spark.read.parquet(path)
    shared = post.join(broadcast_if_small(mixed, mixed), "g", "left_semi")
    shared_path = scratch_path(spark, "ngram-shared")
    shared.write.parquet(shared_path)
    shared = spark.read.parquet(shared_path)
    # the largest component of a posting (heavy) is only the right side of a pair
    heavy = (shared.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g")
             .agg(F.max(F.struct("c", "comp")).alias("m")).select("g", F.col("m.comp").alias("heavy")))
    left = shared.join(heavy, "g").where("comp <> heavy")
    right = shared.select("g", F.col("doc_id").alias("d2"), F.col("comp").alias("c2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    # at the first common n-gram of a linked pair, enough n-grams are left in both sets
    need = (F.col("n") + F.col("n2")) * num
    pairs = (left.join(right, "g").where((F.col("comp") != F.col("c2")) & ((F.col("c2") == F.col("heavy")) | (F.col("doc_id") < F.col("d2"))))
             .where(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (den + num) >= need)
             .select(F.least("doc_id", "d2").alias("a"), F.greatest("doc_id", "d2").alias("b")).distinct())
    # overlap of the two prefixes, the first fragment of a pair: at most the rest
    # of the longer set can come on top, so most pairs end here
    heads = shared.groupBy("doc_id").agg(F.collect_set("g").alias("head"), F.max("n").alias("n"))  # at most a prefix each
    both = (pairs.join(heads.select(F.col("doc_id").alias("a"), F.col("head").alias("ha"), F.col("n").alias("na")), "a")
            .join(heads.select(F.col("doc_id").alias("b"), F.col("head").alias("hb"), F.col("n").alias("nb")), "b"))
    rest = F.floor((F.greatest("na", "nb") * num + den - 1) / den) - 1
    pairs = both.where((F.size(F.array_intersect("ha", "hb")) + rest) * (den + num) >= (F.col("na") + F.col("nb")) * num).select("a", "b")
    more = _verified(pairs, src, n, num, den, fragments, spark, "ngram-pairs")
    final = connected_components(links.unionByName(more))

    member = (classes.join(final, F.col("rep") == F.col("id"), "left")
              .select("set_key", F.coalesce("component", "rep").alias("component_id")))
    return (sets.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(member, "set_key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def _verified(pairs: DataFrame, src: DataFrame, n: int, num: int, den: int, fragments: int, spark, name: str) -> DataFrame:
    """Pairs that link, written to the shared folder (executors may be lost)."""
    path = scratch_path(spark, name + "-candidates")
    pairs.write.parquet(path)
    pairs = spark.read.parquet(path)
    path = scratch_path(spark, name)
    (vertical_overlaps(pairs, src, n, fragments)
     .where(F.col("overlap") * den >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * num)
     .select("a", "b").distinct().write.parquet(path))
    return spark.read.parquet(path)


def sets_bruteforce(texts: list[str | None], n: int = 5) -> list[set]:
    """Reference sets for tests: tuples of words."""
    out = []
    for t in texts:
        words = (t or "").encode().translate(SPACE_WORDS).split()
        out.append(set() if not words else {tuple(words)} if len(words) < n
                   else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)})
    return out


def components_bruteforce(ids: list[int], texts: list[str | None], n: int = 5, num: int = 75, den: int = 100) -> dict[int, int]:
    """Reference components for tests (all pairs; small inputs)."""
    sets, root = sets_bruteforce(texts, n), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and den * inter >= num * len(sets[i] | sets[j]):
                lo, hi = sorted((find(ids[i]), find(ids[j])))
                root[hi] = lo
    return reduce(lambda d, i: d | {i: find(i)}, ids, {})

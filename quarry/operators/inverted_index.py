"""Inverted index in blocks, and top-k set similarity by block bounds.

The index of a table of token sets holds, per token and per aligned range of
``2 ** bits`` ids, one row: the first id, the distances of the following ones from it, how
many they are and the size of the smallest set among them.  Ranges are
aligned, so the blocks of different tokens meet by (token, block) and a token
found in a third of all sets is spread over as many rows, and tasks, as its
ids need; a group never has more than ``2 ** bits`` ids.

``top_k`` finds the best examples of many questions without comparing each
question with each example.  Examples with equal token sets and patterns are
one class; classes are numbered in an order that puts alike ones side by
side, and blocks, blocks of blocks and so on form a tree over these numbers.
A node's bound follows from the question's tokens that occur in it and from
its smallest set, so only nodes that may hold an example better than the k-th
known one are opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def posting_blocks(sets: DataFrame, bits: int = 7) -> DataFrame:
    """(tok, block, n, least, first, gaps) of ``sets(id, toks)``: the ids of a
    token in [block << bits, (block + 1) << bits), ascending, as the first id
    and the distances of the others from it.

    Rows with a null id are not indexed; a repeated id counts once a token.
    """
    e = sets.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.size("toks").alias("size"), F.explode("toks").alias("tok"))
    g = (e.groupBy("tok", F.shiftright("id", bits).alias("block"))
         .agg(F.sort_array(F.collect_set("id")).alias("ids"), F.min("size").alias("least")))
    gaps = F.transform(F.slice("ids", 2, F.size("ids")), lambda x: (x - F.element_at("ids", 1)).cast("int"))
    return g.select("tok", "block", F.size("ids").alias("n"), "least", F.element_at("ids", 1).alias("first"), gaps.alias("gaps"))


def posting_ids() -> Column:
    """The ids of a posting block: its first id and the distances from it."""
    return F.concat(F.array("first"), F.transform("gaps", lambda gap: F.col("first") + gap))


def write_index(sets: DataFrame, path: str, bits: int = 7) -> None:
    """Write the posting blocks of ``sets(id, toks)``, sorted by token and
    block over all files, so that a reader of few tokens skips row groups."""
    posting_blocks(sets, bits).repartitionByRange("tok", "block").sortWithinPartitions("tok", "block").write.parquet(path)


def read_postings(blocks: DataFrame) -> DataFrame:
    """(tok, id) of posting blocks."""
    return blocks.select("tok", F.explode(posting_ids()).alias("id"))


class ClassTree:
    """Classes of examples (equal token set and pattern mask) under a tree of blocks.

    ``classes``: number, ids (the first k), toks, ne, mask, low (smallest id).
    ``postings[j]``: (tok, node) at level j, at level 0 with their numbers.
    ``nodes[j]``: sizes, masks and smallest id of the classes of a node.
    """

    def __init__(self, examples: DataFrame, k: int, bits: int = 6):
        self.k, self.bits = k, bits
        own = Window.partitionBy("key", "mask").orderBy("eid")
        first = (examples.where(F.col("eid").isNotNull()).withColumn("key", F.array_join("toks", " "))
                 .withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= k))
        classes = (first.groupBy("key", "mask").agg(F.sort_array(F.collect_list("eid")).alias("ids"), F.first("toks").alias("toks"))
                   .withColumn("ne", F.size("toks")).withColumn("low", F.element_at("ids", 1)))
        classes = _written(classes, "classes-by-key")  # a range partitioning reads its input twice
        raw = _written(classes.repartitionByRange("mask", "ne", "key").sortWithinPartitions("mask", "ne", "key")
                       .withColumn("at", F.monotonically_increasing_id()).drop("key"), "classes")
        # numbers without the generated id's unused bits between partition and place
        place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        top = raw.agg(F.max(place).alias("p"), F.max(F.shiftright("at", 33)).alias("f")).first()
        width = int(top["p"] or 0).bit_length()
        last = (int(top["f"] or 0) << width) + int(top["p"] or 0)
        self.classes = raw.withColumn("id", F.shiftleft(F.shiftright("at", 33), width) + place).drop("at")
        self.depth = 0
        while last >> (bits * (self.depth + 1)) >= 1 << bits:
            self.depth += 1
        leaf = _written(posting_blocks(self.classes, bits).withColumnRenamed("block", "node"), "postings-0")
        self.postings = [leaf]
        for j in range(self.depth):
            up = self.postings[j].select("tok", F.shiftright("node", bits).alias("node")).distinct()
            self.postings.append(_written(up, f"postings-{j + 1}"))
        stats = [F.min("ne").alias("ne_min"), F.max("ne").alias("ne_max"), F.bit_or("mask").alias("any_mask"), F.bit_and("mask").alias("all_mask"), F.min("low").alias("low")]
        self.nodes = [self.classes.where("ne > 0").groupBy(F.shiftright("id", bits * (j + 1)).alias("node")).agg(*stats) for j in range(self.depth + 1)]

    def first_by_mask(self) -> DataFrame:
        """(mask, empty, eid): the first k ids of every pattern mask, and of the classes without tokens."""
        w = Window.partitionBy("mask", "empty").orderBy("eid")
        return (self.classes.select(F.when(F.col("ne") > 0, F.col("mask")).alias("mask"), (F.col("ne") == 0).alias("empty"), F.explode("ids").alias("eid"))
                .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= self.k).drop("_rn"))


def _mask_jaccard(a: Column, b: Column) -> Column:
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, 0.0).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def _best(found: DataFrame, k: int) -> DataFrame:
    """First k examples of every question by falling score, then id; an example found twice has its better score."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "eid")
    return found.groupBy("qid", "eid").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(questions: DataFrame, tree: ClassTree, boost: Column, score: Callable[[Column, Column, Column, Column, Column], Column]) -> DataFrame:
    """(qid, rank, eid, score): exactly the k best examples of every question, ties by example id.

    ``questions(qid, toks, mask)``; ``boost``: whether a token ``tok`` counts
    twice over in the score; ``score(nq, ne, inter, boosted, pattern)`` must
    not fall when ``inter``, ``boosted`` or ``pattern`` rise or ``ne`` falls.

    An example that shares no token with a question scores by its pattern
    alone, so the first k ids of every pattern stand for all of these.  Those
    that share one are found through the tree: first along each question's k
    most promising nodes, which gives a k-th score to beat, then through
    every node whose bound beats it (or equals it with a smaller id).
    """
    k, bits = tree.k, tree.bits
    q = _written(questions.select("qid", "toks", F.size("toks").alias("nq"), F.col("mask").alias("qmask")), "questions")
    qt = q.select("qid", "nq", "qmask", F.explode("toks").alias("tok")).withColumn("boost", boost)

    # examples without a common token: by (question mask, pattern mask), both few
    kinds = q.select("qmask", (F.col("nq") == 0).alias("bare")).distinct()
    alone = F.when(F.col("bare") | F.col("empty"), 0.0).otherwise(score(F.lit(1), F.lit(1), F.lit(0), F.lit(0), _mask_jaccard(F.col("qmask"), F.col("mask"))))
    w = Window.partitionBy("qmask", "bare").orderBy(F.desc("score"), "eid")
    by_kind = (kinds.crossJoin(tree.first_by_mask()).withColumn("score", alone)
               .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("qmask", "bare", "eid", "score"))
    plain = _written(q.select("qid", "qmask", (F.col("nq") == 0).alias("bare")).join(by_kind, ["qmask", "bare"]).select("qid", "eid", "score"), "topk-plain")

    def to_beat(found: DataFrame) -> DataFrame:
        return found.where(F.col("rank") == k).select(F.col("qid").alias("_q"), F.col("score").alias("_score"), F.col("eid").alias("_eid"))

    def bounded(parts: DataFrame, level: int, beat: DataFrame, width: int | None) -> DataFrame:
        """Nodes of (qid, node, tok) rows that may hold a better example; only each question's ``width`` best where given."""
        g = (parts.groupBy("qid", "node", "nq", "qmask").agg(F.count("*").alias("o"), F.count_if("boost").alias("b"))
             .join(tree.nodes[level], "node"))
        o = F.least("o", "ne_max")
        union = F.bit_count(F.col("qmask").bitwiseOR(F.col("all_mask")))
        pattern = F.when(union == 0, F.when(F.bit_count(F.col("qmask").bitwiseAND(F.col("any_mask"))) > 0, 1.0).otherwise(0.0)).otherwise(
            F.least(F.lit(1.0), F.bit_count(F.col("qmask").bitwiseAND(F.col("any_mask"))) / union))
        g = g.withColumn("bound", score(F.col("nq"), F.greatest("ne_min", o), o, F.col("b"), pattern))
        g = g.join(beat, F.col("qid") == F.col("_q"), "left").where(
            F.col("_score").isNull() | (F.col("bound") > F.col("_score")) | ((F.col("bound") == F.col("_score")) & (F.col("low") < F.col("_eid"))))
        if width:
            w = Window.partitionBy("qid").orderBy(F.desc("bound"), "low", "node")
            g = g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= width)
        return g.select("qid", "node")

    def search(beat: DataFrame, width: int | None, name: str) -> DataFrame:
        level = tree.depth
        alive = _written(bounded(qt.join(tree.postings[level].select("tok", "node"), "tok"), level, beat, width), f"topk-{name}-{level}")
        while level:
            level -= 1
            down = tree.postings[level].select("tok", F.col("node").alias("child"), F.shiftright("node", bits).alias("node"))
            parts = qt.join(alive, "qid").join(down, ["tok", "node"]).drop("node").withColumnRenamed("child", "node")
            alive = _written(bounded(parts, level, beat, width), f"topk-{name}-{level}")
        opened = qt.join(alive, "qid").join(tree.postings[0], ["tok", "node"]).select("qid", "nq", "qmask", "boost", F.explode(posting_ids()).alias("id"))
        scored = (opened.groupBy("qid", "nq", "qmask", "id").agg(F.count("*").alias("o"), F.count_if("boost").alias("b"))
                  .join(tree.classes.select("id", "ne", "mask", "low", "ids"), "id")
                  .withColumn("score", score(F.col("nq"), F.col("ne"), F.col("o"), F.col("b"), _mask_jaccard(F.col("qmask"), F.col("mask")))))
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "low")  # the k best examples are in the k best classes
        return (scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
                .select("qid", F.explode("ids").alias("eid"), "score"))

    first = _written(_best(plain.unionByName(search(to_beat(_best(plain, k)), k, "probe")), k), "topk-first")
    found = _best(first.select("qid", "eid", "score").unionByName(search(to_beat(first), None, "all")), k)
    return found.select("qid", "rank", "eid", "score")

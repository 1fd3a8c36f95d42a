"""Exact cosine near-duplicates by PCA-ordered tiles (operator 1).

Vectors are normalised in double precision and rotated onto the principal
axes of all vectors, so leading coordinates carry most of a product.  A pair
of tiles is compared on a few leading dimensions first; by Cauchy-Schwarz
the rest of a product is at most the product of the two suffix norms, and
pairs whose bound stays below the threshold stop there.  Survivors go on to
more dimensions; the last test is the plain double cosine.

Tiles are grid cells on the two leading axes, cut into blocks of at most
about ``block_rows`` vectors: linked unit vectors are at most
``sqrt(2 - 2 threshold)`` apart, so only neighbouring cells meet.  Equal
vectors collapse to one weighted row first.  A tile pair returns link
counts and a spanning forest, never its pairs, so a dense cluster costs
rows in proportion to its vectors.

Vectors that are null, empty, zero or hold a null or non-finite component
(and rows with a null ``vec_id``) link with nothing; vectors of different
lengths never link.  Every row is returned; repeated rows link with each
other.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.session import scratch_path

_TILE = 1024


def unit_rows(embeddings) -> np.ndarray:
    """Rows scaled to norm 1 in double precision (scaled by the largest component first, against overflow)."""
    x = np.array([np.asarray(e, dtype=np.float64) for e in embeddings], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for d, part in pdf.groupby("d"):
            x = unit_rows(part["embedding"])
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pd.DataFrame({"d": [d], "m": [m.ravel()]})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, an orthogonal matrix whose columns are the axes by falling variance, over all vectors."""
    rows = (vectors.select("d", "embedding").mapInPandas(_moments, "d int, m array<double>")
            .select("d", F.posexplode("m").alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v"))
            .toPandas())  # d * d numbers per vector length
    axes = {}
    for d, part in rows.groupby("d"):
        m = np.zeros(d * d)
        m[part["at"]] = part["v"]
        axes[int(d)] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy()
    return axes


def _cells(axes, width: float):
    """Grid cell of every vector on the two leading axes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                lead = unit_rows(part["embedding"]) @ axes.value[d][:, :2]
                if lead.shape[1] < 2:
                    lead = np.hstack([lead, np.zeros((len(lead), 1))])
                c = np.floor(lead / width).astype(np.int64)
                yield pd.DataFrame({"rep": part["rep"], "n": part["n"], "d": d, "cx": c[:, 0], "cy": c[:, 1], "embedding": part["embedding"]})
    return run


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node reachable over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def tile_links(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float, diagonal: bool):
    """Yield (i, j) arrays of linked pairs of rows, tile by tile.

    x, y: unit rows; rx, ry: the same rows on the principal axes.
    ``diagonal``: x and y are the same rows, only i < j is wanted.
    """
    d, bound = x.shape[1], threshold - 1e-9
    steps = [k for k in (8, 16, 32) if k < d]

    def suffix(r, k):
        return np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0))

    tails = {k: (suffix(rx, k), suffix(ry, k)) for k in steps}
    for i0 in range(0, len(x), _TILE):
        for j0 in range(i0 if diagonal else 0, len(y), _TILE):
            a, b = slice(i0, i0 + _TILE), slice(j0, j0 + _TILE)
            i = j = None
            done = 0
            for k in steps:
                if i is None:  # the suffix product is one more dimension of the first product
                    m = np.hstack([rx[a, :k], tails[k][0][a, None]]) @ np.hstack([ry[b, :k], tails[k][1][b, None]]).T
                    i, j = np.nonzero(m >= bound)
                    if diagonal and i0 == j0:
                        keep = i < j
                        i, j = i[keep], j[keep]
                    if len(i) > m.size // 8:  # dense tile: one whole product is cheaper
                        break
                    part = np.zeros(len(i))
                part = part + (rx[i0 + i, done:k] * ry[j0 + j, done:k]).sum(axis=1)
                keep = part + tails[k][0][i0 + i] * tails[k][1][j0 + j] >= bound
                i, j, part, done = i[keep], j[keep], part[keep], k
                if not len(i):
                    break
            if i is None or len(i) > 100_000:
                m = x[a] @ y[b].T
                if i is None:
                    i, j = np.nonzero(m >= bound)
                    if diagonal and i0 == j0:
                        keep = i < j
                        i, j = i[keep], j[keep]
                keep = m[i, j] >= threshold
            else:
                keep = np.einsum("ij,ij->i", x[i0 + i], y[j0 + j]) >= threshold
            if keep.any():
                yield i0 + i[keep], j0 + j[keep]


def _compare(axes, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        diagonal = not len(right)
        x = unit_rows(left["embedding"])
        order = np.argsort(-(x @ axes.value[d][:, 0]))  # near rows share tiles
        left, x = left.iloc[order], x[order]
        if diagonal:
            right, y = left, x
        else:
            y = unit_rows(right["embedding"])
        rx = x @ axes.value[d]
        ry = rx if diagonal else y @ axes.value[d]
        nx, ny = left["n"].to_numpy(), right["n"].to_numpy()
        lx, ly = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        shift = 0 if diagonal else len(x)
        forest_a, forest_b = [], []
        for i, j in tile_links(x, y, rx, ry, threshold, diagonal):
            lx += np.bincount(i, weights=ny[j], minlength=len(x)).astype(np.int64)
            ly += np.bincount(j, weights=nx[i], minlength=len(y)).astype(np.int64)
            node, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
            label = smallest_labels(len(node), at[:len(i)], at[len(i):])
            own = np.flatnonzero(label != np.arange(len(node)))
            forest_a.append(node[own])
            forest_b.append(node[label[own]])
        ids = left["rep"].to_numpy() if diagonal else np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        links = lx + ly if diagonal else np.concatenate([lx, ly])
        if not forest_a:
            return pd.DataFrame({"id": [], "root": [], "links": []}).astype("int64")
        label = smallest_labels(len(ids), np.concatenate(forest_a), np.concatenate(forest_b))
        own = np.flatnonzero(links > 0)
        return pd.DataFrame({"id": ids[own], "root": ids[label[own]], "links": links[own]})
    return run


def cosine_components(vectors: DataFrame, threshold: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    fine = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))

    path = scratch_path(spark, "vectors")
    (v.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"))
     .withColumn("d", F.size("embedding")).write.parquet(path))
    # vectors are numbered in the order of their smallest vec_id, so a component's smallest number stands for its
    # smallest vec_id, also where different vectors share one
    distinct = spark.read.parquet(path)
    path = scratch_path(spark, "vectors-numbered")
    distinct.repartitionByRange("smallest").sortWithinPartitions("smallest").withColumn("rep", F.monotonically_increasing_id()).write.parquet(path)
    reps = spark.read.parquet(path)
    axes = spark.sparkContext.broadcast(principal_axes(reps))

    path = scratch_path(spark, "vector-cells")
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)
    reps.mapInPandas(_cells(axes, width), f"rep long, n long, d int, cx long, cy long, embedding {dict(reps.dtypes)['embedding']}").write.parquet(path)
    cells = spark.read.parquet(path)
    blocks = cells.groupBy("d", "cx", "cy").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    rows = (cells.join(F.broadcast(blocks), ["d", "cx", "cy"])  # cells: at most (2 / width + 2) ^ 2 per vector length
            .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")))
    one = blocks.select("d", "cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    near = one.select("d", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("block").alias("ab"),
                      F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"))
    pairs = (near.withColumn("cx", F.col("ax") + F.col("o.i")).withColumn("cy", F.col("ay") + F.col("o.j")).join(one, ["d", "cx", "cy"])
             .where(F.struct("ax", "ay", "ab") <= F.struct("cx", "cy", "block"))
             .select("d", "ax", "ay", "ab", F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("block").alias("bb")))
    path = scratch_path(spark, "vector-pairs")
    pairs.write.parquet(path)
    pairs = spark.read.parquet(path)
    names = ["d", "ax", "ay", "ab", "bx", "by", "bb"]
    own = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("ab") == F.col("bb"))
    side = [rows.withColumnsRenamed({"cx": f"{s}x", "cy": f"{s}y", "block": f"{s}b"})
            .join(pairs if s == "a" else pairs.where(~own), ["d", f"{s}x", f"{s}y", f"{s}b"])
            .select(*names, F.lit(int(s == "b")).alias("side"), "rep", "n", "embedding") for s in "ab"]
    found = (side[0].unionByName(side[1]).groupBy(*names)
             .applyInPandas(_compare(axes, threshold), "id long, root long, links long"))
    path = scratch_path(spark, "vector-links")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    comps = connected_components(found.where("id <> root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_rep = (reps.join(links, F.col("rep") == links["id"], "left").drop("id").join(comps, F.col("rep") == comps["id"], "left")
               .select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("first"))
               .join(reps.select(F.col("rep").alias("first"), F.col("smallest").alias("component_id")), "first").drop("first"))
    return (v.join(per_rep, F.col("fine") & (F.col("embedding") == F.col("e")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))

"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest member of each component: (id, component), one row per id of an edge.

    Each round replaces every edge by edges to the smallest neighbour
    (first towards larger ids, then towards smaller ones), which ends in
    stars after a logarithmic number of rounds.  Minima are taken with a
    map-side combined aggregate and joined back, so a hub is never gathered
    in one row; lineage is cut with reliable checkpoints.

    Null ids and self loops are ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint())
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        # large star: every neighbour above u is linked to the smallest of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    """Every u has one edge, to a v that has none (edges go from larger to smaller ids)."""
    return (e.groupBy("u").count().where("count > 1").isEmpty()
            and e.join(e.select(F.col("u").alias("inner")).distinct(), F.col("v") == F.col("inner"), "left_semi").isEmpty())

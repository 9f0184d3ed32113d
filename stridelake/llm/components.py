"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _stars(work: Workspace, pairs: DataFrame, large: bool, name: str) -> DataFrame:
    """Link each node's neighbours to the least of them: the larger ones (large star), or the smaller ones and itself.

    The least neighbours are written before they are joined, so that Spark may split the join at a node with very many neighbours.
    """
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = work.put(near.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u")), f"{name}-least")
    linked = near.join(least, "u")
    out = linked.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select("u", F.col("_m").alias("v")))
    out = work.put(out.where("u != v").distinct(), name)
    work.drop(f"{name}-least")
    return out


def _unsettled(pairs: DataFrame) -> DataFrame:
    """Nodes that point to two others, or to one that points on itself; without any, the pairs are stars."""
    onward = pairs.select("u").join(pairs.select(F.col("v").alias("u")), "u", "left_semi")
    return onward.unionByName(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u"))


def components(work: Workspace, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """node, root of every node that has an edge (columns ``u`` and ``v``): root is the least node of its component.

    Every round writes its pairs to the shared folder, so lineage stays short. Ends when the
    pairs are stars: then a round would change nothing.
    """
    pairs = work.put(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for k in range(1, most_rounds + 1):
        if _unsettled(pairs).isEmpty():
            break
        pairs = _stars(work, _stars(work, pairs, True, f"{name}-{k}-large"), False, f"{name}-{k}")
        work.drop(f"{name}-{k}-large", f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Stars now: every node but the roots points to its root.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components of a link table, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.lineage import cut


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps: each node's larger neighbours
    are linked to its smallest neighbour, then its smaller ones.  Groups are
    reduced with ``min`` only (combined before the shuffle) and joined back, so
    a hub's neighbours never meet in one group; a join that is skewed by a hub
    is split by AQE.  Each round is checkpointed, so lineage stays short and a
    lost executor costs one round.  NULL ends and self-links are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    # a > b: every edge points from the larger to the smaller node
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest
        star = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        star = star.distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.union(low.toDF("a", "b")).distinct())
        after = _state(e)
        if after == before:
            # stars: every node points to its component
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return e.toDF("node", "component").union(roots)
        before = after

"""Connected components by alternating large-star and small-star steps over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, unstage


def _large(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Edges run from the larger node ``a`` to the smaller ``b``."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: no node has two parents, or a parent and a child."""
    up, down = F.col("a").alias("node"), F.col("b").alias("node")
    ends = e.select(up, F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(down, F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count() == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the component's smallest node.

    Hubs are split by the skew handling of the joins, and least neighbours are pre-aggregated.  Each round is a staged
    table, the one before it is deleted.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(e):
            break
        large = stage(_large(e), "edges")
        new = stage(_small(large), "edges")
        unstage(e)
        unstage(large)
        e = new
    else:
        raise RuntimeError("components did not settle")
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()

"""Size of the minimal automaton of a word set, without building it.

Prefixes whose sets of suffixes are equal share a state.  A set of suffixes is told by its size and two sums of hashes of
its suffixes, which map-side aggregation adds up, so no set is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_BYTES, NODE_BYTES, TRANSITION_BYTES, WIDE_NODE = 64, 1, 5, 63


def states(words: DataFrame) -> DataFrame:
    """``s1, s2, n, degree``: one row for each state of the minimal automaton of a non-empty set."""
    hexes = words.select(F.hex("word").alias("h"))
    cut = hexes.select("h", F.explode(F.sequence(F.lit(0), F.length("h"), F.lit(2))).alias("k"))
    parts = cut.select(F.expr("left(h, k)").alias("prefix"), F.expr("substr(h, k + 1)").alias("suffix"))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "suffix").cast("decimal(20,0)"))
    sets = parts.groupBy("prefix").agg(total(1).alias("s1"), total(2).alias("s2"), F.count(F.lit(1)).alias("n"))
    children = sets.where("prefix <> ''").groupBy(F.expr("left(prefix, length(prefix) - 2)").alias("parent")).agg(F.count(F.lit(1)).alias("degree"))
    named = sets.join(children, F.col("prefix") == F.col("parent"), "left").select("s1", "s2", "n", F.coalesce("degree", F.lit(0)).alias("degree"))
    return named.distinct()


def automaton(words: DataFrame) -> DataFrame:
    """One row: ``num_nodes, num_transitions, index_bytes``."""
    size = NODE_BYTES + (F.col("degree") >= WIDE_NODE).cast("bigint") + TRANSITION_BYTES * F.col("degree")
    found = states(words).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("t"), F.coalesce(F.sum(size), F.lit(0)).alias("b"))
    empty = F.col("n") == 0
    return found.select(
        F.when(empty, 1).otherwise(F.col("n")).cast("bigint").alias("num_nodes"), F.col("t").cast("bigint").alias("num_transitions"), (F.when(empty, NODE_BYTES).otherwise(F.col("b")) + HEADER_BYTES).cast("bigint").alias("index_bytes")
    )

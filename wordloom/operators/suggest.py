"""Frequency-weighted dictionaries and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest count of a word; sums beyond it stay there.
MAX_COUNT = (1 << 63) - 1


def weighted(words: DataFrame, column: str = "word", count: str | None = None, threshold: int = 1) -> DataFrame:
    """``word, frequency``: summed counts of at least ``threshold``."""
    one = F.col(count).cast("decimal(38,0)") if count else F.lit(1).cast("decimal(38,0)")
    total = F.least(F.sum(one), F.lit(MAX_COUNT).cast("decimal(38,0)")).cast("bigint")
    return words.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(total.alias("frequency")).where(F.col("frequency") >= threshold)


def with_frequency(found: DataFrame, frequencies: DataFrame) -> DataFrame:
    return found.join(frequencies, "word").select("query", "word", "distance", "frequency")


def closest(found: DataFrame) -> DataFrame:
    """All rows at each query's least distance."""
    return found.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy("distance"))).where("_r = 1").drop("_r")


def top(found: DataFrame) -> DataFrame:
    """The best row of each query: least distance, then highest frequency, then byte order."""
    order = Window.partitionBy("query").orderBy("distance", F.desc("frequency"), "word")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def match_counts(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, matches`` for every query, none included."""
    n = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query").distinct().join(n, "query", "left").select("query", F.coalesce("n", F.lit(0)).cast("bigint").alias("matches"))


def summary(counts: DataFrame, column: str, p: float = 0.99) -> DataFrame:
    """``average, percentile``: the latter is the value at index floor(p (n - 1)) of the ascending values."""
    by_value = counts.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranks = by_value.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.floor(F.lit(p) * (F.col("total") - 1))
    return ranks.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("average"), F.min(F.when(F.col("upto") > at, F.col("v"))).alias("percentile"))

"""Fuzzy search of a stream of queries against a stored dictionary: a stream-static equi-join on deletion variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import byte_text, deletions, levenshtein_within
from ..operators.dictionary import MAX_QUERY_BYTES, MAX_WORD_BYTES, Dictionary


def variants(words: Dictionary, max_distance: int) -> DataFrame:
    """Deletion keys of a dictionary, to be written once and read by the stream."""
    w = words.words.where((F.col("word") != "") & (F.octet_length("word") <= MAX_WORD_BYTES)).withColumn("wb", byte_text(F.col("word")))
    return w.select("word", "wb", F.explode(deletions(F.col("wb"), max_distance)).alias("key"))


def search_stream(queries: DataFrame, keys: DataFrame, max_distance: int, column: str = "query") -> DataFrame:
    """``query, word, distance`` for each streamed query row; a pair may come once for each shared key unless deduplicated,
    so only the least shared key's row is kept, without state."""
    q = queries.select(F.col(column).alias("query")).where(F.octet_length("query") <= MAX_QUERY_BYTES).withColumn("qb", byte_text(F.col("query")))
    q = q.withColumn("qks", deletions(F.col("qb"), max_distance)).withColumn("qk", F.explode("qks"))
    pairs = q.join(keys, F.col("qk") == F.col("key"))
    least = F.array_min(F.array_intersect("qks", deletions(F.col("wb"), max_distance)))
    pairs = pairs.where(F.col("key") == least)
    return pairs.select("query", "word", levenshtein_within(F.col("qb"), F.col("wb"), max_distance).alias("distance")).where(F.col("distance") <= max_distance)

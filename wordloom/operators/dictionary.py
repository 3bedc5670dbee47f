"""The dictionary: a set of words, with membership and fuzzy search for whole batches of queries.

Deviations from a single-word index: results are complete at any size (no buffers that drop rows), null words are dropped, and
null queries match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS, bits_within, byte_text, deletions, letters, levenshtein_within, may_swap, neighbours, osa_bytes, probes, segments
from ..plans.planner import ALGORITHMS, BROADCAST_QUERIES, STRATEGIES, choose
from ..sources.words import read_dictionary, write_dictionary
from . import statistics

#: Longest query that is answered, and longest word that search returns, in bytes.
MAX_QUERY_BYTES, MAX_WORD_BYTES, MAX_DISTANCE = 64, 255, 254


class InputNotSorted(ValueError):
    """Words that were said to be sorted are not."""


def _ascends(words: DataFrame) -> bool:
    """Do the rows ascend, adjacent duplicates apart?  Each partition checks its own rows; only the ends of partitions meet."""
    rows = words.select("word", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("task"))
    before = F.lag("word").over(Window.partitionBy("task").orderBy("at"))
    per = rows.withColumn("before", before).groupBy("task").agg(F.min_by("word", "at").alias("first"), F.max_by("word", "at").alias("last"), F.max(F.coalesce((F.col("before") > F.col("word")) & (F.col("before") != ""), F.lit(False))).alias("falls"))
    ends = per.withColumn("before", F.lag("last").over(Window.orderBy("task")))  # a row for each task
    return ends.where("falls or (before > first and before <> '')").limit(1).count() == 0


class Dictionary:
    """Built from any string column; ``words`` is its only column's set.  ``keyed`` has ``word, n, mask, pairs`` (bytes, letters, neighbours) as stored."""

    def __init__(self, words: DataFrame, keyed: DataFrame | None = None) -> None:
        self.words = words
        self._keyed = keyed
        self._counts: dict[str, int] = {}

    @property
    def keyed(self) -> DataFrame:
        return keys_of(self.words) if self._keyed is None else self._keyed

    @classmethod
    def build(cls, df: DataFrame, column: str = "word", sort_input: bool = True) -> "Dictionary":
        """Distinct non-null words.  With ``sort_input=False`` the rows must already ascend strictly, adjacent duplicates apart."""
        words = df.select(F.col(column).cast("string").alias("word")).where("word is not null")
        if not sort_input and not _ascends(words):
            raise InputNotSorted("words do not ascend")
        return cls(words.distinct())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Dictionary":
        keyed = read_dictionary(spark, path)
        return cls(keyed.select("word"), keyed)

    def save(self, path: str, overwrite: bool = True) -> "Dictionary":
        write_dictionary(self.keyed, path, overwrite)
        return self

    def sorted(self) -> DataFrame:
        return self.words.orderBy("word")

    def n_words(self) -> int:
        if "words" not in self._counts:
            self._counts["words"] = self.words.count()
        return self._counts["words"]

    def contains(self, df: DataFrame, column: str = "query", flag: str = "present") -> DataFrame:
        """``df`` with a boolean: is the value a word?  (null: no)"""
        known = self.words.select(F.col("word").alias("known_word"))
        return df.join(known, df[column] == F.col("known_word"), "left").withColumn(flag, F.col("known_word").isNotNull()).drop("known_word")

    def members(self, df: DataFrame, column: str = "query") -> DataFrame:
        return df.join(self.words, df[column] == self.words["word"], "left_semi")

    def non_members(self, df: DataFrame, column: str = "query") -> DataFrame:
        return df.join(self.words, df[column] == self.words["word"], "left_anti")

    def fuzzy_join(
        self,
        queries: DataFrame,
        column: str = "query",
        max_distance: int = 1,
        metric: str = "levenshtein",
        algorithm: str = "bit-parallel",
        strategy: str | None = None,
        max_query_bytes: int | None = MAX_QUERY_BYTES,
        counters: Observation | None = None,
    ) -> DataFrame:
        """``query, word, distance``: all words within ``max_distance`` byte edits of each distinct query.

        ``algorithm`` never changes results, only the plan; ``strategy`` overrides the planner.  Queries over ``max_query_bytes``
        match nothing (None: all are answered, with words of any length).  ``counters`` observes ``candidates`` and ``found`` rows.
        """
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm!r}")
        if not 0 <= max_distance <= MAX_DISTANCE:
            raise ValueError(f"max_distance is from 0 to {MAX_DISTANCE}")
        if strategy is not None and strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        q = queries.select(F.col(column).cast("string").alias("query")).where("query is not null").distinct()
        w = self.keyed.where("word <> ''")
        if max_query_bytes is not None:
            q = q.where(F.octet_length("query") <= max_query_bytes)
            w = w.where(F.col("n") <= MAX_WORD_BYTES)
        if max_distance == 0:
            return q.join(w, F.col("query") == F.col("word")).select("query", "word", F.lit(0).cast("bigint").alias("distance"))
        if strategy in (None, "lengths"):
            n_queries = q.count()
            strategy = strategy or choose(max_distance, n_queries, self.n_words(), algorithm)
            if strategy == "lengths" and n_queries > BROADCAST_QUERIES:
                raise ValueError("too many queries to broadcast")
        swaps = metric == "damerau"
        wide = min(2 * max_distance, MAX_DISTANCE) if swaps else max_distance
        q = q.withColumn("qb", byte_text(F.col("query"))).withColumn("qn", F.length("qb")).withColumn("qmask", letters(F.col("qb"))).withColumn("qpairs", neighbours(F.col("qb")))
        w = w.withColumn("wb", byte_text(F.col("word")))
        near = (F.abs(F.col("qn") - F.col("n")) <= max_distance) & bits_within(F.col("qmask"), F.col("mask"), max_distance)
        near = near & bits_within(F.col("qpairs"), F.col("pairs"), (3 if swaps else 2) * max_distance)
        pairs = {"lengths": _by_lengths, "segments": _by_segments, "deletions": _by_deletions}[strategy](q, w, near, max_distance, wide)
        if counters is not None:
            pairs = pairs.withColumn("plain", F.levenshtein("qb", "wb", wide))
            hits = (F.col("plain") >= 0) & (F.col("plain") <= max_distance)
            pairs = pairs.observe(counters, F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(hits.cast("long")), F.lit(0)).alias("found")).drop("plain")
        if not swaps:
            # one evaluation, behind a generator
            found = pairs.select("query", "word", F.explode(F.array(levenshtein_within(F.col("qb"), F.col("wb"), max_distance))).alias("distance"))
            return found.where("distance is not null")
        # most candidates have no swap, and keep their Levenshtein distance; one evaluation of the rest
        pairs = pairs.withColumn("plain", F.explode(F.array(F.levenshtein("qb", "wb", wide)))).where(F.col("plain") >= 0)
        pairs = pairs.where((F.col("plain") <= max_distance) | may_swap(F.col("qb"), F.col("wb")))
        exact = F.when((F.col("plain") > 1) & may_swap(F.col("qb"), F.col("wb")), osa_bytes(F.col("qb"), F.col("wb"))).otherwise(F.col("plain").cast("bigint"))
        return pairs.select("query", "word", F.explode(F.array(exact)).alias("distance")).where(F.col("distance") <= max_distance)

    def fuzzy_batches(self, queries: DataFrame, column: str = "query", size: int = 8192, **options) -> Iterator[list[tuple[str, str, int]]]:
        """The rows of ``fuzzy_join`` in batches of ``size``; the caller may stop and go on at any time, and one partition at most is held."""
        batch: list[tuple[str, str, int]] = []
        for row in self.fuzzy_join(queries, column, **options).toLocalIterator():
            batch.append((row["query"], row["word"], row["distance"]))
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def fuzzy_search(self, query: str, max_distance: int = 1, metric: str = "levenshtein", algorithm: str = "bit-parallel") -> list[tuple[str, int]]:
        """One query; words in byte order with their distances."""
        one = self.words.sparkSession.createDataFrame([(query,)], "query string")
        return [(r["word"], r["distance"]) for r in self.fuzzy_join(one, "query", max_distance, metric, algorithm).orderBy("word").collect()]

    def num_nodes(self) -> int:
        """States of the minimal automaton (1 for an empty dictionary)."""
        return self.statistics()["num_nodes"]

    def statistics(self) -> dict[str, int]:
        if "num_nodes" not in self._counts:
            self._counts |= statistics.automaton(self.words).first().asDict()
        return {k: v for k, v in self._counts.items() if k != "words"}


def keys_of(words: DataFrame) -> DataFrame:
    """``word, n, mask, pairs``: words with their number of bytes, letters and neighbouring bytes."""
    b = byte_text(F.col("word"))
    return words.select("word", F.octet_length("word").alias("n"), letters(b).alias("mask"), neighbours(b).alias("pairs"))


def _by_lengths(q: DataFrame, w: DataFrame, near, d: int, wide: int) -> DataFrame:
    """Every query is broadcast once for each byte length that it can meet; a word meets the queries of its own length only.

    Comparing is the work here, so words are dealt to all cores first: a stored dictionary may be one small file.
    """
    spark = w.sparkSession
    w = w.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = q.withColumn("at", F.explode(F.sequence(F.greatest(F.col("qn") - d, F.lit(1)), F.col("qn") + d)))
    return w.join(F.broadcast(at), (F.col("n") == F.col("at")) & near & (F.levenshtein("qb", "wb", wide) >= 0)).select("query", "word", "qb", "wb")


def _by_segments(q: DataFrame, w: DataFrame, near, d: int, wide: int) -> DataFrame:
    """Of the ``wide + 1`` even pieces of a word, a query within ``wide`` plain edits holds one unchanged, moved by ``d`` places at most.

    Words shorter than that have no pieces; they meet queries by length.
    """
    parts = wide + 1
    asks, has = ["query", "qb", "qn", "qmask", "qpairs"], ["word", "wb", "n", "mask", "pairs"]
    pieces = w.where(F.col("n") >= parts).select(*has, F.explode(segments(F.col("wb"), parts)).alias("s")).select(*has, "s.part", "s.text")
    sizes = F.sequence(F.greatest(F.col("qn") - d, F.lit(parts)), F.greatest(F.col("qn") + d, F.lit(parts)))
    asked = q.select(*asks, F.explode(sizes).alias("at"))
    asked = asked.select(*asks, "at", F.explode(probes(F.col("qb"), F.col("at"), parts, d)).alias("s")).select(*asks, "at", F.col("s.part").alias("q_part"), F.col("s.text").alias("q_text"))
    long = pieces.join(asked, (F.col("n") == F.col("at")) & (F.col("part") == F.col("q_part")) & (F.col("text") == F.col("q_text")) & near).select("query", "word", "qb", "wb").distinct()
    short = w.where(F.col("n") < parts)
    brief = q.where(F.col("qn") < parts + d).withColumn("at", F.explode(F.sequence(F.greatest(F.col("qn") - d, F.lit(1)), F.col("qn") + d)))
    return long.union(short.join(brief, (F.col("n") == F.col("at")) & near).select("query", "word", "qb", "wb"))


def _by_deletions(q: DataFrame, w: DataFrame, near, d: int, wide: int) -> DataFrame:
    """Both sides have a row for each deletion variant of their prefixes, a bounded number a word at any length."""
    asked = q.withColumn("q_key", F.explode(deletions(F.col("qb"), d)))
    known = w.withColumn("w_key", F.explode(deletions(F.col("wb"), d)))
    return asked.join(known, (F.col("q_key") == F.col("w_key")) & near).select("query", "word", "qb", "wb").distinct()


def limit_per_query(found: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows a query, in byte order of words."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("word"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy("query", "distance", "word")


def near_duplicates(words: DataFrame, column: str, max_distance: int, metric: str = "levenshtein") -> DataFrame:
    """``a, b, distance``: pairs of different values within the distance, a before b; of any length, the empty one apart."""
    both = Dictionary.build(words, column)
    found = both.fuzzy_join(both.words.withColumnRenamed("word", "query"), "query", max_distance, metric, max_query_bytes=None)
    return found.where("query < word").select(F.col("query").alias("a"), F.col("word").alias("b"), "distance")

"""Registered queries of the dictionary engine, and their DuckDB SQL.

The dictionary is the vocabulary of all texts of ``documents``; it is built once for a session and table, stored in the shared
folder, and opened by every query but those that build.  The query sets are the fixed benchmark words, and
misspellings (middle byte deleted) of every ASCII word of 3 to 20 bytes of ``part.p_name``, ``nation.n_name`` and
``benchmark.text``.  The two largest searches (``fuzzy_lev_d4``, ``fuzzy_osa_d3``) take the benchmark's words alone, as that benchmark does.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import deletions, misspellings
from .operators import suggest
from .operators.dictionary import Dictionary, limit_per_query, near_duplicates, ranked
from .operators.statistics import automaton, states
from .sources.words import from_list, read_queries, read_words, shared_folder, signature, text_words

# The benchmark's query words, ten of a kind (one, two, three bytes off; common misspellings; invented words).
BENCHMARK_WORDS = """
algoritm definately occured seperate recieve accomodate goverment enviroment necesary developement
algritm defnately ocured seprate receve acomodate govrnment envroment necesry devlopment
algrtm defnatly ocred sepate recve acomodte govrment envrment necery devlpment
teh wiht abuot becuase freind langauge libary mispell occassion restarant
xyloquartz brontoflex quasimorph hypervolt neuroflux cryptoplasm megasphere ultraquench photonweb gravitrex
""".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_words(table(spark, sf_dir, "documents"))


def built(spark: SparkSession, sf_dir: str) -> Dictionary:
    return Dictionary.build(occurrences(spark, sf_dir))


_stored: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The path that ``write`` has written for this table, once for an application and state of the table's files."""
    key = (spark.sparkContext.applicationId, name, signature(table(spark, sf_dir, "documents")))
    if key not in _stored:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _stored[key] = path
    return _stored[key]


def vocabulary(spark: SparkSession, sf_dir: str) -> Dictionary:
    """The stored dictionary of ``documents``."""
    return Dictionary.load(spark, _once(spark, sf_dir, "dictionary", lambda path: built(spark, sf_dir).save(path)))


def stored_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_once(spark, sf_dir, "frequencies", lambda path: suggest.weighted(occurrences(spark, sf_dir)).write.parquet(path)))


def misspelt(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    columns = (("part", "p_name"), ("nation", "n_name"), ("benchmark", "text"))
    words = reduce(DataFrame.union, [text_words(table(spark, sf_dir, t), c) for t, c in columns])
    return misspellings(words, every=every)


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and misspellings."""
    return from_list(spark, BENCHMARK_WORDS, "query").union(misspelt(spark, sf_dir)).distinct()


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_list(spark, BENCHMARK_WORDS, "query")


def fuzzy(queries, distance: int, **options):
    return lambda spark, sf_dir: vocabulary(spark, sf_dir).fuzzy_join(queries(spark, sf_dir), "query", distance, **options)


def found2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(all_queries, 2)(spark, sf_dir)


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.weighted(occurrences(spark, sf_dir), "word", threshold=2)


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.with_frequency(found2(spark, sf_dir), stored_frequencies(spark, sf_dir))


def osa_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(spark, sf_dir)
    q = misspelt(spark, sf_dir)
    swapped = words.fuzzy_join(q, "query", 1, "damerau")
    return swapped.join(words.fuzzy_join(q, "query", 1), ["query", "word"], "left_anti")


def from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary and the benchmark's words as text files, with comments and blank lines, read back and matched."""
    words = _once(spark, sf_dir, "words-file", lambda path: vocabulary(spark, sf_dir).words.select("word").union(from_list(spark, [""])).write.text(path))
    lines = ["# queries", "", *BENCHMARK_WORDS]
    asked = _once(spark, sf_dir, "queries-file", lambda path: from_list(spark, lines, "value").coalesce(1).write.text(path))
    return Dictionary.build(read_words(spark, words, max_bytes=64)).fuzzy_join(read_queries(spark, asked), "query", 2)


def from_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of words that are sorted already; their order is checked."""
    path = _once(spark, sf_dir, "sorted-words", lambda path: vocabulary(spark, sf_dir).sorted().coalesce(1).write.parquet(path))
    return Dictionary.build(spark.read.parquet(path), sort_input=False).words


def special_queries(spark: SparkSession) -> DataFrame:
    return from_list(spark, ["", "a", "é", "x" * 64, "x" * 65, "the" * 22], "query")


def pairs_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "part"), "p_name", 3)


QUERIES = {
    "dict_build": lambda s, d: built(s, d).words,
    "dict_stored": lambda s, d: vocabulary(s, d).words,
    "dict_from_sorted": from_sorted,
    "dict_sorted": lambda s, d: vocabulary(s, d).sorted(),
    "word_filter_len": lambda s, d: vocabulary(s, d).words.where(F.octet_length("word") <= 12),
    "contains_flag": lambda s, d: vocabulary(s, d).contains(misspelt(s, d)),
    "members": lambda s, d: vocabulary(s, d).members(misspelt(s, d)),
    "non_members": lambda s, d: vocabulary(s, d).non_members(misspelt(s, d)),
    "fuzzy_d0": fuzzy(misspelt, 0),
    "fuzzy_lev_d1": fuzzy(misspelt, 1),
    "fuzzy_lev_d2": fuzzy(all_queries, 2),
    "fuzzy_lev_d3": fuzzy(all_queries, 3),
    "fuzzy_lev_d4": fuzzy(benchmark_words, 4),
    "fuzzy_lev_dfa_d2": fuzzy(all_queries, 2, algorithm="dfa"),
    "fuzzy_lev_deletions_d2": fuzzy(all_queries, 2, strategy="deletions"),
    "fuzzy_osa_d1": fuzzy(misspelt, 1, metric="damerau"),
    "fuzzy_osa_d2": fuzzy(all_queries, 2, metric="damerau"),
    "fuzzy_osa_d3": fuzzy(benchmark_words, 3, metric="damerau"),
    "fuzzy_osa_dfa_d1": fuzzy(misspelt, 1, metric="damerau", algorithm="dfa"),
    "osa_extra_over_lev": osa_extra,
    "fuzzy_special_queries": lambda s, d: vocabulary(s, d).fuzzy_join(special_queries(s), "query", 2),
    "fuzzy_from_files": from_files,
    "fuzzy_limit_per_query": lambda s, d: limit_per_query(found2(s, d), 3),
    "fuzzy_ranked": lambda s, d: ranked(found2(s, d)),
    "weighted_dict": frequencies,
    "suggest_closest": lambda s, d: suggest.closest(suggestions(s, d)),
    "suggest_top": lambda s, d: suggest.top(suggestions(s, d)),
    "near_dup_selfjoin": pairs_of_names,
    "match_counts": lambda s, d: suggest.match_counts(found2(s, d), all_queries(s, d)),
    "match_summary": lambda s, d: suggest.summary(suggest.match_counts(found2(s, d), all_queries(s, d)), "matches"),
    "automaton_size": lambda s, d: automaton(vocabulary(s, d).words),
    "automaton_degrees": lambda s, d: states(vocabulary(s, d).words).groupBy("degree").agg(F.count(F.lit(1)).alias("n_states")),
    "deletion_keys": lambda s, d: misspelt(s, d).select("query", F.explode(deletions(F.col("query"), 1, prefix=None)).alias("key")),
    "deletion_keys_prefix": lambda s, d: misspelt(s, d).select("query", F.explode(deletions(F.col("query"), 1)).alias("key")),
    "misspellings_every_third": lambda s, d: misspelt(s, d, every=3),
}

_SPLIT = r"unnest(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'))"
_OCC = f"occ AS (SELECT * FROM (SELECT {_SPLIT.format('text')} AS word FROM documents) WHERE word <> '')"
_VOC = f"{_OCC}, voc AS (SELECT DISTINCT word FROM occ)"
_CUT = "substr(word, 1, (length(word) // 2)::INT) || substr(word, (length(word) // 2)::INT + 2)"


def _names(*columns: tuple[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT {_SPLIT.format(c)} AS word FROM {t}" for t, c in columns)
    return f"SELECT DISTINCT {_CUT} AS query FROM ({every}) WHERE strlen(word) = length(word) AND strlen(word) BETWEEN 3 AND 20"


_MISS = "q AS (" + _names(("part", "p_name"), ("nation", "n_name"), ("benchmark", "text")) + ")"
_MISS_WORDS = "SELECT DISTINCT word FROM (" + " UNION ALL ".join(f"SELECT {_SPLIT.format(c)} AS word FROM {t}" for t, c in (("part", "p_name"), ("nation", "n_name"), ("benchmark", "text"))) + ") WHERE strlen(word) = length(word) AND strlen(word) BETWEEN 3 AND 20"
_LIST = ", ".join(f"('{w}')" for w in BENCHMARK_WORDS)
_FIXED = f"q AS (SELECT DISTINCT query FROM (SELECT * FROM (VALUES {_LIST}) AS b(query) UNION ALL {_MISS[6:-1]}))"
_BENCH = f"q AS (SELECT DISTINCT query FROM (VALUES {_LIST}) AS b(query))"


def _fuzzy_sql(q: str, d: int) -> str:
    return (
        f"{_VOC}, {q}, found AS (SELECT query, word, levenshtein(query, word)::BIGINT AS distance FROM q JOIN voc ON abs(strlen(query) - strlen(word)) <= {d} "
        f"WHERE strlen(query) <= 64 AND strlen(word) <= 255 AND word <> '' AND levenshtein(query, word) <= {d})"
    )


_SWAPS = """swaps AS (SELECT query, unnest(list_transform(range(1, strlen(query)), lambda i:
    substr(hex(query), 1, (2 * i - 2)::INT) || substr(hex(query), (2 * i + 1)::INT, 2) || substr(hex(query), (2 * i - 1)::INT, 2) || substr(hex(query), (2 * i + 3)::INT))) AS h
  FROM q WHERE strlen(query) BETWEEN 2 AND 64),
swapped AS (SELECT DISTINCT query, word FROM swaps JOIN voc ON h = hex(word))"""
# Optimal string alignment by rows of its table, over bytes as pairs of hex digits, for words near enough that hold a swapped pair of the query's.
_BYTES = "list_transform(range(0, strlen({x})), lambda i: substr(hex({x}), (2 * i + 1)::INT, 2))"


def _osa_sql(q: str, d: int) -> str:
    return f"""{_VOC}, {q}, near AS (SELECT query, word, levenshtein(query, word)::BIGINT AS plain FROM q JOIN voc ON abs(strlen(query) - strlen(word)) <= {d}
  WHERE strlen(query) <= 64 AND strlen(word) <= 255 AND word <> '' AND levenshtein(query, word) <= {2 * d}),
split AS (SELECT query, word, plain, {_BYTES.format(x="query")} AS a, {_BYTES.format(x="word")} AS b FROM near),
swap AS (SELECT *, plain > 1 AND len(list_filter(range(1, len(a)), lambda i: a[i] <> a[i + 1] AND list_contains(list_transform(range(1, len(b)), lambda j: b[j] || b[j + 1]), a[i + 1] || a[i]))) > 0 AS has FROM split),
dp AS (SELECT query, word, list_last(list_reduce(range(1, len(a) + 1), lambda s, i: {{'two': s.one, 'one': list_reduce(range(1, len(b) + 1),
    lambda r, j: list_append(r, least(r[j] + 1, s.one[j + 1] + 1, s.one[j] + (a[i] <> b[j])::BIGINT,
      CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN s.two[j - 1] + 1 ELSE 9999::BIGINT END)), [i::BIGINT])}},
    {{'two': range(0, len(b) + 1), 'one': range(0, len(b) + 1)}}).one) AS distance FROM swap WHERE has),
found AS (SELECT query, word, distance FROM dp WHERE distance <= {d} UNION ALL SELECT query, word, plain FROM swap WHERE NOT has AND plain <= {d})"""


_FREQ = "freq AS (SELECT word, count(*) AS frequency FROM occ GROUP BY word)"
_SUGGEST = f"WITH {_fuzzy_sql(_FIXED, 2)}, {_FREQ}, sug AS (SELECT query, word, distance, frequency FROM found JOIN freq USING (word))"
_STATES = f"""WITH {_VOC}, p AS (SELECT left(h, k::INT) AS prefix, substr(h, k::INT + 1) AS suffix FROM (SELECT hex(word) AS h, unnest(range(0, length(hex(word)) + 1, 2)) AS k FROM voc)),
s AS (SELECT prefix, md5(string_agg(suffix, ',' ORDER BY suffix)) AS sig FROM p GROUP BY prefix),
c AS (SELECT left(prefix, length(prefix) - 2) AS prefix, count(*) AS degree FROM s WHERE prefix <> '' GROUP BY 1),
st AS (SELECT DISTINCT sig, coalesce(degree, 0) AS degree FROM s LEFT JOIN c USING (prefix))"""
_SPECIAL = "q AS (SELECT * FROM (VALUES (''), ('a'), ('é'), (repeat('x', 64)), (repeat('x', 65)), (repeat('the', 22))) AS b(query))"
_COUNTS = f"WITH {_fuzzy_sql(_FIXED, 2)}, m AS (SELECT q.query, count(found.word) AS matches FROM q LEFT JOIN found USING (query) GROUP BY q.query)"

_DELETED = """WITH {miss} SELECT DISTINCT query, key FROM (SELECT query, {w} AS key FROM q UNION ALL
  SELECT query, unnest(list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, (i - 1)::INT) || substr({w}, (i + 1)::INT))) FROM q)"""

ORACLE_SQL = {
    "dict_build": f"WITH {_VOC} SELECT word FROM voc",
    "dict_sorted": f"WITH {_VOC} SELECT word FROM voc ORDER BY word",
    "word_filter_len": f"WITH {_VOC} SELECT word FROM voc WHERE strlen(word) <= 12",
    "contains_flag": f"WITH {_VOC}, {_MISS} SELECT query, query IN (SELECT word FROM voc) AS present FROM q",
    "members": f"WITH {_VOC}, {_MISS} SELECT query FROM q WHERE query IN (SELECT word FROM voc)",
    "non_members": f"WITH {_VOC}, {_MISS} SELECT query FROM q WHERE query NOT IN (SELECT word FROM voc)",
    "fuzzy_d0": f"WITH {_VOC}, {_MISS} SELECT query, query AS word, 0::BIGINT AS distance FROM q WHERE query IN (SELECT word FROM voc)",
    "fuzzy_lev_d1": f"WITH {_fuzzy_sql(_MISS, 1)} SELECT * FROM found",
    "fuzzy_lev_d2": f"WITH {_fuzzy_sql(_FIXED, 2)} SELECT * FROM found",
    "fuzzy_lev_d3": f"WITH {_fuzzy_sql(_FIXED, 3)} SELECT * FROM found",
    "fuzzy_lev_d4": f"WITH {_fuzzy_sql(_BENCH, 4)} SELECT * FROM found",
    "fuzzy_lev_dfa_d2": f"WITH {_fuzzy_sql(_FIXED, 2)} SELECT * FROM found",
    "fuzzy_lev_deletions_d2": f"WITH {_fuzzy_sql(_FIXED, 2)} SELECT * FROM found",
    "fuzzy_osa_d2": f"WITH {_osa_sql(_FIXED, 2)} SELECT * FROM found",
    "fuzzy_osa_d3": f"WITH {_osa_sql(_BENCH, 3)} SELECT * FROM found",
    "fuzzy_osa_dfa_d1": f"WITH {_osa_sql(_MISS, 1)} SELECT * FROM found",
    "fuzzy_from_files": f"WITH {_fuzzy_sql(_BENCH, 2)} SELECT * FROM found",
    "dict_stored": f"WITH {_VOC} SELECT word FROM voc",
    "dict_from_sorted": f"WITH {_VOC} SELECT word FROM voc",
    "misspellings_every_third": f"SELECT DISTINCT {_CUT} AS query FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM ({_MISS_WORDS})) WHERE i % 3 = 0",
    "fuzzy_osa_d1": f"WITH {_fuzzy_sql(_MISS, 1)}, {_SWAPS} SELECT * FROM found UNION ALL SELECT query, word, 1::BIGINT FROM swapped ANTI JOIN found USING (query, word)",
    "osa_extra_over_lev": f"WITH {_fuzzy_sql(_MISS, 1)}, {_SWAPS} SELECT query, word, 1::BIGINT AS distance FROM swapped ANTI JOIN found USING (query, word)",
    "fuzzy_special_queries": f"WITH {_fuzzy_sql(_SPECIAL, 2)} SELECT * FROM found",
    "fuzzy_limit_per_query": f"WITH {_fuzzy_sql(_FIXED, 2)} SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query ORDER BY word) <= 3",
    "fuzzy_ranked": f"WITH {_fuzzy_sql(_FIXED, 2)} SELECT * FROM found ORDER BY query, distance, word",
    "weighted_dict": f"WITH {_OCC}, {_FREQ} SELECT * FROM freq WHERE frequency >= 2",
    "suggest_closest": f"{_SUGGEST} SELECT * FROM sug QUALIFY rank() OVER (PARTITION BY query ORDER BY distance) = 1",
    "suggest_top": f"{_SUGGEST} SELECT * FROM sug QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, frequency DESC, word) = 1",
    "near_dup_selfjoin": "WITH n AS (SELECT DISTINCT p_name AS w FROM part WHERE p_name IS NOT NULL) SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w)::BIGINT AS distance FROM n x JOIN n y ON x.w < y.w WHERE levenshtein(x.w, y.w) <= 3 AND x.w <> ''",
    "match_counts": f"{_COUNTS} SELECT query, matches FROM m",
    "match_summary": f"{_COUNTS}, r AS (SELECT matches, row_number() OVER (ORDER BY matches) - 1 AS i, count(*) OVER () AS n FROM m) SELECT avg(matches) AS average, min(matches) FILTER (i >= floor(0.99::DOUBLE * (n - 1))) AS percentile FROM r",
    "automaton_size": f"{_STATES} SELECT count(*)::BIGINT AS num_nodes, sum(degree)::BIGINT AS num_transitions, (64 + sum(1 + (degree >= 63)::BIGINT + 5 * degree))::BIGINT AS index_bytes FROM st",
    "automaton_degrees": f"{_STATES} SELECT degree::BIGINT AS degree, count(*) AS n_states FROM st GROUP BY degree",
    "deletion_keys": _DELETED.format(miss=_MISS, w="query"),
    "deletion_keys_prefix": _DELETED.format(miss=_MISS, w="substr(query, 1, 7)"),
}

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wordloom import catalog
from wordloom.__main__ import main
from wordloom.functions import distance as D
from wordloom.functions.automaton import QueryAutomaton
from wordloom.functions.distance import misspellings
from wordloom.operators import suggest
from wordloom.operators.dictionary import Dictionary, InputNotSorted, limit_per_query, near_duplicates
from wordloom.plans.planner import choose
from wordloom.sources.words import from_list, read_queries, read_words
from wordloom.streaming.lookup import search_stream, variants

SMALL = "cat bat hat car card care cart bar barn bare bark dark dart far farm fast fat rat sat mat".split()
SWAPS = "the teh eth het cat act tac friend freind fiend frined ab ba a b abc bac acb algorithm algortihm hello hlelo".split()


def lev(a, b, swaps=False):
    a, b = a.encode(), b.encode()
    t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    return t[-1][-1]


def brute(words, queries, d, swaps=False):
    return {(q, w, n) for q in queries if len(q.encode()) <= 64 for w in set(words) if w and len(w.encode()) <= 255 and (n := lev(q, w, swaps)) <= d}


def rows(df):
    return {tuple(r) for r in df.collect()}


def dictionary(spark, words):
    return Dictionary.build(from_list(spark, words))


def test_scalar_distances(spark):
    pairs = [("café", "cafe", 2, 2), ("ca", "abc", 3, 3), ("teh", "the", 2, 1), ("", "abc", 3, 3), ("ab", "ba", 2, 1), ("", "", 0, 0)]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in pairs], "a string, b string")
    got = df.select(D.levenshtein(F.col("a"), F.col("b")), D.osa(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(x, y) for _, _, x, y in pairs]


def test_random_distances(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abé", k=rng.randrange(7))), "".join(rng.choices("abé", k=rng.randrange(7)))) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", D.levenshtein(F.col("a"), F.col("b")), D.osa(F.col("a"), F.col("b"))).collect()
    assert all(r[2] == lev(r[0], r[1]) and r[3] == lev(r[0], r[1], True) for r in got)


@pytest.mark.parametrize("strategy", ["lengths", "segments", "deletions"])
@pytest.mark.parametrize("metric", ["levenshtein", "damerau"])
def test_every_strategy_equals_brute_force(spark, strategy, metric):
    rng = random.Random(1)
    odd = ["".join(rng.choices("abcé", k=rng.randrange(1, 14))) for _ in range(150)]
    words = dictionary(spark, SMALL + SWAPS + odd)
    queries = ["", "cat", "teh", "ab", "freind", "carx", "zzz", "algortihm", "x" * 65, *odd[:6], *[w[1::-1] + w[2:] for w in odd[6:10]]]
    for d in (1, 2, 3):
        found = words.fuzzy_join(from_list(spark, queries, "query"), "query", d, metric, strategy=strategy)
        assert found.count() == len(rows(found))
        assert rows(found) == brute(SMALL + SWAPS + odd, queries, d, metric == "damerau")


def test_near_duplicates_of_any_length(spark):
    words = [c + "b" * n for n in (61, 62, 63, 64, 65, 260) for c in ("", "a")]
    want = {tuple(sorted((x, y))) + (n,) for x in words for y in words if x < y and (n := lev(x, y)) <= 2}
    assert rows(near_duplicates(from_list(spark, words), "word", 2)) == want
    assert rows(near_duplicates(from_list(spark, words), "word", 2, "damerau")) == want


def test_planner():
    assert choose(0, 10**9, 10**9) == "equal" and choose(2, 100, 10**5) == "lengths" and choose(2, 100, 10**5, "dfa") == "segments"
    assert choose(2, 10**6, 10**9) == "deletions" and choose(3, 10**6, 10**9) == "segments"


def test_many_queries_at_distance_three(spark):
    """Beyond the broadcast limit: 20,000 queries, pieces against pieces."""
    words = [f"{k:010d}" for k in range(0, 400_000, 40)]
    queries = spark.range(20_000).select(F.format_string("%010d", F.col("id") * 997 % 400_000).alias("query"))
    found = dictionary(spark, words[:300]).fuzzy_join(queries, "query", 1, strategy="segments")
    sample = [r["query"] for r in queries.where("query in ('0000000040', '0000011964', '0000003988')").collect()]
    assert rows(found.where(F.col("query").isin(sample))) == brute(words[:300], sample, 1)
    with pytest.raises(ValueError):
        dictionary(spark, words[:300]).fuzzy_join(queries, "query", 1, strategy="lengths")


def test_batches_and_counters(spark):
    words, seen = dictionary(spark, SMALL), Observation("seen")
    asked = from_list(spark, ["cat", "bar"], "query")
    batches = list(words.fuzzy_batches(asked, size=3, max_distance=1))
    every = [r for b in batches for r in b]
    assert set(every) == brute(SMALL, ["cat", "bar"], 1) and [len(b) for b in batches[:-1]] == [3] * (len(batches) - 1)
    assert words.fuzzy_join(asked, "query", 1, counters=seen).count() == len(every)
    assert seen.get["found"] == len(every) <= seen.get["candidates"]


@pytest.mark.parametrize("metric", ["levenshtein", "damerau"])
def test_automaton(metric):
    words = SMALL + SWAPS + ["", "é", "acb", "xyz"]
    for query in ("cat", "teh", "", "abc", "é"):
        for d in range(4):
            a = QueryAutomaton(query, d, metric)
            assert a.num_states >= 1
            for w in words:
                n = lev(query, w, metric == "damerau")
                assert a.distance(w) == (n if n <= d else None)
                if n <= d:
                    assert all(a.viable(w[:k]) for k in range(len(w) + 1))
    assert not QueryAutomaton("cat", 1, metric).viable("zzz") and QueryAutomaton("cat", 1).num_states < QueryAutomaton("cat", 2).num_states


def test_misspellings(spark):
    words = from_list(spark, ["abc", "abcd", "ab", "x" * 21, "café", "zebra", "abc", "mouse"])
    assert rows(misspellings(words)) == {("ac",), ("abd",), ("zera",), ("mose",)}
    assert rows(misspellings(words, every=2)) == {("ac",), ("mose",)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "words.txt").write_text("cat\ncar\ncart\nteh\n")
    assert main(["build", str(tmp_path / "words.txt"), str(tmp_path / "dict")]) == 0
    assert main(["query", str(tmp_path / "dict"), "cat", "--distance", "1"]) == 0
    assert main(["query", str(tmp_path / "dict"), "the", "--metric", "damerau"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out == ["4 words", "3 words within 1 of cat", "d=0  cat", "d=1  car", "d=1  cart", "1 words within 1 of the", "d=1  teh"]


def test_stored_dictionary_follows_its_table(spark, tmp_path):
    """The stored dictionary is opened again for the same files, and built anew when they change."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([("one two",)], "text string").coalesce(1).write.parquet(path)
    first = catalog.vocabulary(spark, str(tmp_path)).words
    assert catalog.vocabulary(spark, str(tmp_path)).words.inputFiles() == first.inputFiles() and rows(first) == {("one",), ("two",)}
    spark.createDataFrame([("three",)], "text string").coalesce(1).write.mode("overwrite").parquet(path)
    assert rows(catalog.vocabulary(spark, str(tmp_path)).words) == {("three",)}


def test_limits_nulls_and_empty_word(spark):
    words = ["", "a", None, "b" * 255, "c" * 256, "d" * 64]
    d = dictionary(spark, words)
    queries = from_list(spark, ["a", None, "d" * 64, "d" * 65, ""], "query")
    assert rows(d.fuzzy_join(queries, "query", 1)) == {("a", "a", 0), ("", "a", 1), ("d" * 64, "d" * 64, 0)}
    flags = {r["query"]: r["present"] for r in d.contains(from_list(spark, ["", "c" * 256, "zz", None], "query")).collect()}
    assert flags == {"": True, "c" * 256: True, "zz": False, None: False}
    assert rows(d.fuzzy_join(queries, "query", 0)) == {("a", "a", 0), ("d" * 64, "d" * 64, 0)}


def test_results_are_complete(spark):
    words = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnop"]
    assert dictionary(spark, words).fuzzy_join(from_list(spark, ["qqq"], "query"), "query", 3).count() == len(words)


def test_bad_arguments(spark):
    d = dictionary(spark, SMALL)
    q = from_list(spark, ["cat"], "query")
    for options in ({"metric": "hamming"}, {"algorithm": "trie"}, {"max_distance": 255}, {"max_distance": -1}, {"strategy": "cross"}):
        with pytest.raises(ValueError):
            d.fuzzy_join(q, "query", **options)


def test_search_order_and_members(spark):
    d = dictionary(spark, ["algorithm", "algorism", "algebra", "cat", "car", "cart", "card"])
    assert d.fuzzy_search("algoritm", 1) == [("algorism", 1), ("algorithm", 1)]
    assert d.fuzzy_search("car", 2) == [("car", 0), ("card", 1), ("cart", 1), ("cat", 1)]
    q = from_list(spark, ["car", "cars"], "query")
    assert rows(d.members(q)) == {("car",)} and rows(d.non_members(q)) == {("cars",)}


@pytest.mark.parametrize("words,nodes", [(["hello"], 6), (["abc", "abd"], 4), (["bing", "sing"], 5), ([], 1), (["a", "b", "c"], 2), (["car", "card", "care"], 5)])
def test_node_counts(spark, words, nodes):
    assert dictionary(spark, words).num_nodes() == nodes


def test_sorted_input(spark):
    assert Dictionary.build(from_list(spark, ["a", "b", "b", "c"]).coalesce(1), sort_input=False).n_words() == 3
    with pytest.raises(InputNotSorted):
        Dictionary.build(from_list(spark, ["b", "a"]).coalesce(1), sort_input=False)
    parts = from_list(spark, ["c", "d"]).coalesce(1).union(from_list(spark, ["a", "b"]).coalesce(1))
    with pytest.raises(InputNotSorted):
        Dictionary.build(parts, sort_input=False)
    assert Dictionary.build(from_list(spark, ["a", "b"]).coalesce(1).union(from_list(spark, ["b", "c"]).coalesce(1)), sort_input=False).n_words() == 3


def test_files(spark, tmp_path):
    (tmp_path / "words.txt").write_bytes(b"cat\r\ncar\n\n" + b"x" * 70 + b"\n")
    (tmp_path / "queries.txt").write_text("# comment\ncat\n\nbat\n")
    assert rows(read_words(spark, str(tmp_path / "words.txt"), max_bytes=64)) == {("cat",), ("car",)}
    assert [r[0] for r in read_words(spark, str(tmp_path / "words.txt"), max_words=2).collect()] == ["cat", "car"]
    assert rows(read_queries(spark, str(tmp_path / "queries.txt"))) == {("cat",), ("bat",)}
    path = str(tmp_path / "dict")
    dictionary(spark, SMALL).save(path)
    assert Dictionary.load(spark, path).n_words() == len(SMALL)
    with pytest.raises(ValueError):
        Dictionary.load(spark, str(tmp_path / "none"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        Dictionary.load(spark, str(tmp_path / "other"))


def test_suggestions(spark):
    found = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("q", "c", 2), ("p", "c", 2)], "query string, word string, distance bigint")
    freq = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1)], "word string, frequency bigint")
    both = suggest.with_frequency(found, freq)
    assert rows(suggest.top(both)) == {("q", "b", 1, 9), ("p", "c", 2, 1)}
    assert {r["word"] for r in suggest.closest(both).where("query = 'q'").collect()} == {"a", "b"}
    assert rows(limit_per_query(found, 2)) == {("q", "a", 1), ("q", "b", 1), ("p", "c", 2)}
    counts = suggest.match_counts(found, from_list(spark, ["q", "p", "none"], "query"))
    assert rows(counts) == {("q", 3), ("p", 1), ("none", 0)}
    assert tuple(suggest.summary(counts, "matches").first()) == (4 / 3, 1)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("cat\ncarx\n")
    keys = variants(dictionary(spark, SMALL), 1)
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "query")
    run = search_stream(stream, keys, 1).writeStream.format("memory").queryName("found").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert rows(spark.table("found")) == brute(SMALL, ["cat", "carx"], 1)
    assert spark.table("found").count() == len(brute(SMALL, ["cat", "carx"], 1))


@pytest.mark.parametrize("gone", [("wordloom/llm",), ("corpus_pipeline.py",), ("wordloom/llm", "corpus_pipeline.py"), ()])
def test_entry_without_optional_parts(tmp_path, gone):
    """The entry of a copy of the tree without the optional parts still lists the dictionary's queries."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    left_out = shutil.ignore_patterns(".git", "__pycache__", "tests", *[os.path.basename(x) for x in gone])
    shutil.copytree(top, tmp_path / "tree", ignore=left_out)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert set(catalog.QUERIES) <= set(names)
    if "wordloom/llm" in gone:
        assert set(names) == set(catalog.QUERIES)

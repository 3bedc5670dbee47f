"""``python -m wordloom build WORDS OUT`` and ``python -m wordloom query DICT WORD [--distance N] [--metric M] [--algorithm A]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.distance import METRICS
from .operators.dictionary import Dictionary
from .plans.planner import ALGORITHMS
from .sources.words import read_words


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wordloom")
    actions = parser.add_subparsers(dest="action", required=True)
    build = actions.add_parser("build")
    build.add_argument("words")
    build.add_argument("output")
    query = actions.add_parser("query")
    query.add_argument("dictionary")
    query.add_argument("word")
    query.add_argument("--distance", type=int, default=1)
    query.add_argument("--metric", choices=METRICS, default="levenshtein")
    query.add_argument("--algorithm", choices=ALGORITHMS, default="bit-parallel")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("wordloom").getOrCreate()
    if args.action == "build":
        made = Dictionary.build(read_words(spark, args.words)).save(args.output)
        print(f"{made.n_words()} words")
        return 0
    found = Dictionary.load(spark, args.dictionary).fuzzy_search(args.word, args.distance, args.metric, args.algorithm)
    print(f"{len(found)} words within {args.distance} of {args.word}")
    for word, distance in sorted(found, key=lambda x: (x[1], x[0].encode())):
        print(f"d={distance}  {word}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

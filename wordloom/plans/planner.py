"""Choice of the physical strategy of the similarity join."""

from __future__ import annotations

#: Queries that are broadcast at most (a checked size); beyond it both sides are shuffled on keys.
BROADCAST_QUERIES = 10_000
#: Compared pairs up to which queries are broadcast.
CHEAP_PAIRS = 5_000_000_000
ALGORITHMS = ("bit-parallel", "dfa")
STRATEGIES = ("equal", "lengths", "segments", "deletions")


def choose(max_distance: int, n_queries: int, n_words: int, algorithm: str = "bit-parallel") -> str:
    """All strategies are exact.

    ``equal``: equi-join on the word (distance 0).
    ``lengths``: queries are broadcast, hashed by the byte lengths that they can meet, and compared by their letters before the distance.
    ``segments``: equi-join on pieces of words, of which a near query holds one unchanged.
    ``deletions``: equi-join on deletion variants of prefixes.
    """
    if max_distance == 0:
        return "equal"
    if algorithm == "dfa":  # matching by keys made beforehand, like a compiled table
        return "segments"
    if n_queries <= BROADCAST_QUERIES and n_queries * n_words <= CHEAP_PAIRS:
        return "lengths"
    return "deletions" if max_distance <= 2 else "segments"

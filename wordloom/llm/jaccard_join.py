"""Exact n-gram Jaccard self-join and its connected components, by filters under several global token orders.

A document is the set of its distinct shingles (64-bit hashes of 4 lower-cased words).  If two sets of n and m shingles
have Jaccard similarity of at least ``percent``, they share a token among the first n - ceil(percent n) + 1 tokens of
one and the first m - ceil(percent m) + 1 of the other under *every* global token order.  Three orders are used.  All
put rare tokens first, by the binary logarithm of a count over the whole corpus, and break ties by different hashes.
Candidates come from the first order's postings, where the position of a shared token must leave room for the overlap
that a link of these sizes needs; they must also share prefix tokens, and enough of them, under the second and third
order; only then are the sets compared, exactly.

The result is one row per document with its component, so links inside a component that is already connected
need not be verified:

1. Documents with equal sets are one node.
2. In every posting list each node is paired with the node that has the fewest tokens before it (a star); these pairs are filtered and verified.
3. Posting lists that still hold several components of the verified links are expanded, but only across components, and
   these pairs are filtered and verified too.  After that, every candidate pair is verified or joined by verified links.

Scale: postings are pre-aggregated per token before they are joined, so a token of many documents is a skewed join that
adaptive execution splits, never a group in one task.  Token counts are a sketch of ``SKETCH`` counters (any order is
exact; collisions only make it less selective), sent as ``SKETCH`` bytes.  Nodes, tokens and sets are compared by 64-bit hashes.

Edge cases: null, empty and blank texts have no shingles, and are their own component; texts of one to three words have one
shingle; a null id is ignored as a component's smallest id unless all are null; ids are cast to long; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetools import hash_spans, mix, slices, spread, text_bytes, words
from .components import components
from .staging import arrow_map, release, stage, unstage

SKETCH_BITS = 22
CHUNKS = 1024
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, offsets = text_bytes(column)
    low = _LOWER[buf]
    starts, ends, per = words(low, offsets)
    h = hash_spans(low, starts, ends)
    if len(h) >= n:
        s = mix(h[: len(h) - n + 1] + np.uint64(n))
        for k in range(1, n):
            s = mix(s ^ h[k : len(h) - n + 1 + k])
    else:
        s = np.zeros(0, np.uint64)
    at = np.append(0, np.cumsum(per))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            one = mix(h[a : a + 1] + np.uint64(b - a))
            for k in range(a + 1, b):
                one = mix(one ^ h[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(tokens: np.ndarray) -> int:
    """Hash of a set."""
    h = mix(np.array([len(tokens)], np.uint64) ^ np.bitwise_xor.reduce(mix(tokens ^ np.uint64(SEEDS[0]))) ^ mix(np.array([tokens.sum()], np.uint64)))
    return int(h.view(np.int64)[0])


def _levels(rows: DataFrame, n: int) -> np.ndarray:
    """log2 of each counter of documents per token, over all documents."""
    size = 1 << SKETCH_BITS
    width = size // CHUNKS

    def count(batches):
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for piece in slices(batch, "text"):
                flat = np.concatenate(shingle_sets(piece.column("text"), n) or [np.zeros(0, np.uint64)])
                total += np.bincount((flat & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in total.reshape(CHUNKS, width)], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                sums[chunk] = sums.get(chunk, np.zeros(width, np.uint64)) + np.frombuffer(pa.decompress(counts.as_py(), 4 * width, codec="zstd"), np.uint32)
        level = [np.log2(np.maximum(x, 1).astype(np.float64)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "level": pa.array(level, pa.binary())})

    parts = arrow_map(rows.select("text"), count, "chunk int, counts binary")
    out = np.zeros((CHUNKS, width), np.uint8)
    for row in arrow_map(parts.repartition(CHUNKS, "chunk"), add, "chunk int, level binary").collect():  # 2^SKETCH_BITS bytes
        out[row["chunk"]] = np.frombuffer(row["level"], np.uint8)
    return out.reshape(-1)


def _prefixes(rows: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """``id, key, n, node, o1 (longs), o2, o3 (ints)`` per document."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def cut(batches):
        level = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), n)
                sizes = np.array([len(x) for x in sets], np.int64)
                take = np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)
                flat = np.concatenate(sets or [np.zeros(0, np.uint64)])
                high = level[(flat & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                at = np.append(0, np.cumsum(sizes)).tolist()
                columns = []
                for k, seed in enumerate(SEEDS):
                    key = high | (mix(flat ^ np.uint64(seed)) >> np.uint64(8))
                    picked = [np.argpartition(key[a:b], t - 1)[:t] + a for a, b, t in zip(at[:-1], at[1:], take.tolist()) if t]
                    if k == 0:  # in order, for the positions
                        picked = [x[np.argsort(key[x])] for x in picked]
                    tokens = flat[np.concatenate(picked)] if picked else flat[:0]
                    values = pa.array(tokens.view(np.int64)) if k == 0 else pa.array((mix(tokens ^ np.uint64(1)) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)), pa.int32()), values))
                nodes = pa.array([_node(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("key"), pa.array(sizes), nodes, *columns], names=["id", "key", "n", "node", "o1", "o2", "o3"])

    return stage(arrow_map(rows, cut, "id long, key long, n long, node long, o1 array<long>, o2 array<int>, o3 array<int>"), "prefixes")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, tokens`` of the wanted ``(key, node)``, one document a node, computed anew from its text."""

    def sets(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                found = shingle_sets(piece.column("text"), n)
                right = [k for k, (x, node) in enumerate(zip(found, piece.column("node").to_pylist())) if len(x) and _node(x) == node]
                flat = np.concatenate([found[k] for k in right] or [np.zeros(0, np.uint64)])
                at = np.append(0, np.cumsum([len(found[k]) for k in right])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("node").take(pa.array(right, pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["node", "tokens"])

    texts = docs.join(wanted, "key").select("text", "node")  # a row's key is its own, null ids or not; equal rows share it
    return stage(arrow_map(texts, sets, "node long, tokens array<long>").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among candidate ``pairs(a, b)``: filters of the second and third order, then the exact comparison."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("o2").alias(f"{x}2"), F.col("o3").alias(f"{x}3"))
    # what the prefixes share and the longer rest of a set bound the overlap; equal 32-bit hashes within a prefix are allowed for
    rest = F.greatest(F.col("an") - F.size("a2"), F.col("bn") - F.size("b2"))
    lost = lambda o: F.size(f"a{o}") - F.size(F.array_distinct(f"a{o}")) + F.size(f"b{o}") - F.size(F.array_distinct(f"b{o}"))
    enough = lambda o: F.size(F.array_intersect(f"a{o}", f"b{o}")) + lost(o) + rest >= F.ceil((F.col("an") + F.col("bn")) * percent / F.lit(100 + percent))
    passed = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3") & enough("2") & enough("3")).select("a", "b")
    passed = stage(passed, "candidates")
    wanted = passed.select(F.col("a").alias("node")).union(passed.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(docs, wanted.join(nodes.select("node", "key"), "node"), n)
    full = passed.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    both = F.size(F.array_intersect("ta", "tb"))
    links = stage(full.where(both * 100 >= (F.size("ta") + F.size("tb") - both) * percent).select("a", "b"), "links")
    unstage(sets)
    unstage(passed)
    return links


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns: tells rows of one id apart.  Columns that hold maps are hashed as JSON, as maps cannot be."""
    return F.xxhash64(*[F.to_json(F.struct(docs[f"`{f.name}`"])) if "map<" in f.dataType.simpleString() else docs[f"`{f.name}`"] for f in docs.schema])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document."""
    placed = _placed(docs, id_col, text_col, n, percent)
    first = placed.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    out = placed.join(first, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _placed(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Staged ``id, key, n, label`` per document; the label of its component is null without shingles."""
    release(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), row_key(docs).alias("key"), docs[text_col].alias("text"))
    prefixes = _prefixes(rows, _levels(rows, n), n, percent)
    which = stage(prefixes.select("id", "key", "n", "node"), "which")
    nodes = stage(prefixes.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("o1").alias("o1"), F.first("o2").alias("o2"), F.first("o3").alias("o3")), "nodes")
    unstage(prefixes)
    release(docs.sparkSession)
    postings = nodes.select("node", "n", F.posexplode("o1").alias("pos", "token"))
    # an overlap of `least(x, y)` shingles is a link; the first shared token has that many tokens from it on, in both
    least = lambda x, y: F.ceil((x + y) * percent / F.lit(100 + percent))
    fits = lambda nx, px, ny, py: (px <= nx - least(nx, ny)) & (py <= ny - least(nx, ny))
    many = postings.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    shared = stage(postings.join(many, "token").select("token", "node", "n", "pos"), "postings")  # most tokens have one node only
    release(docs.sparkSession)
    hubs = shared.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    star = shared.join(hubs, "token").where((F.col("hub.node") != F.col("node")) & fits(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    star = stage(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = _verified(star, nodes, rows, n, percent)
    label = stage(components(links), "labels")
    lists = shared.join(label, "node", "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    lists = stage(lists, "labelled-postings")
    unstage(shared)
    # by size too, so that a pair of groups meets only if a member of either fits one of the other
    groups = lists.groupBy("token", "label", "n").agg(F.min("pos").alias("pos"))
    mixed = groups.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    groups = stage(groups.join(mixed, "token"), "groups")
    one, two = (groups.select("token", F.col("label").alias(f"{x}l"), F.col("n").alias(f"{x}n"), F.col("pos").alias(f"{x}p")) for x in "ab")
    meet = (F.col("al") < F.col("bl")) & fits(F.col("an"), F.col("ap"), F.col("bn"), F.col("bp"))
    across = one.join(two, (one["token"] == two["token"]) & meet).select(one["token"].alias("token"), "al", "an", "bl", "bn")
    member = lambda x: lists.select("token", F.col("label").alias(f"{x}l"), F.col("n").alias(f"{x}n"), F.col("node").alias(x), F.col("pos").alias(f"{x}p"))
    room = lambda x: F.col(f"{x}p") <= F.col(f"{x}n") - least(F.col("an"), F.col("bn"))
    pairs = across.join(member("a"), ["token", "al", "an"]).where(room("a")).join(member("b"), ["token", "bl", "bn"]).where(room("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _verified(pairs, nodes, rows, n, percent)
    # the components of the first links are the nodes of the graph that the later links join
    under = label.select(F.col("node").alias("under"), "label")
    ends = more.join(under.toDF("a", "la"), "a", "left").join(under.toDF("b", "lb"), "b", "left")
    over = stage(components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).toDF("label", "over"), "over")
    placed = which.join(label, "node", "left").select("id", "key", "n", F.coalesce("label", "node").alias("label"))
    placed = placed.join(over, "label", "left").select("id", "key", "n", F.coalesce("over", "label").alias("label"))
    placed = stage(placed, "placed")
    for table in (which, nodes, lists, groups, star, links, label, more, over):
        unstage(table)
    release(docs.sparkSession)
    return placed


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """One row of each component: that with the smallest id, nulls last, and of these that with the smallest hash of all columns.

    Rows without shingles stay; rows that share all columns' values stay once.
    """
    placed = _placed(docs, id_col, **({"text_col": "text", "n": 4, "percent": 85} | params))
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("best")
    stays = placed.where("label is not null").groupBy("label").agg(best).select("best.id", "best.key")
    stays = stays.union(placed.where("label is null").select("id", "key")).distinct()
    # whole rows go in a struct, so that no name of theirs can clash
    rows = docs.select(docs[id_col].cast("long").alias("id"), row_key(docs).alias("key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    kept = rows.join(stays.toDF("stay_id", "stay_key"), F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("key") == F.col("stay_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*")

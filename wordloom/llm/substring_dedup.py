"""Removal of repeated substrings: bytes covered by a ``length``-byte string that starts twice or more in the corpus.

1. Every window of ``length`` bytes belongs to one anchor: the place of the least hash among the ``GRAM``-byte strings in
   it.  Equal windows have equal anchors, so a window can repeat only if its anchor's hash does.  The windows of an anchor
   start one after another and lie in one context of about 1.5 windows.  The contexts of one hash are a group.
2. Groups of one context are gone.  Contexts that repeat as a whole are covered as a whole, and one copy of each different
   context goes on if its group has several of them.
3. Groups are gathered into shards of about ``SHARD_BYTES``.  Each shard's suffix array is built by induced sorting; neighbours
   whose permuted common prefix reaches ``length`` are repeats.
4. A group over ``GROUP_BYTES`` (a passage of very many documents whose surroundings differ) is split before that: the windows of
   each context are halved by the place of the anchor in them, and each half joins the group of those that hold the same bytes
   where all its windows overlap.  Equal windows have their anchor at the same place and share these bytes, so they stay
   together.  Step 2 is applied to the new groups, and so on; groups of single windows hold one context each and are settled by
   step 2, so splitting ends.  At most two parts of a context straddle a passage's edge at any size, so a context's parts
   stay few.
5. Covered intervals are joined to the texts and cut out.

Hashes of groups, contexts and documents have 64 bits (context hashes within a group, so 128).
Scale: what is shuffled besides the texts is one small row for about each 135 bytes.  Python works on pieces of about ``PIECE_BYTES``
of texts, contexts or one shard, whatever the sizes of texts, batches and groups; a single text is held whole, and its windows
are hashed in pieces.

Edge cases: null text is empty; texts under ``length`` bytes stay whole; equal rows remove each other whole and share one
key, and their text is read for contexts once; no rows give no rows.  Ids are cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetools import by_size, gathered, hash_spans, mix, slices, spread, text_bytes
from .staging import arrow_map, stage, unstage
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 400
GRAM = 128
GROUP_BYTES = 256 << 10
SHARD_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
_POS = np.uint64((1 << 26) - 1)
_NONE = np.zeros(0, np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM``-byte strings (a power of two), from hashes of their halves."""
    n = len(buf) - 8
    h = np.ndarray((n - 7,), dtype="<u8", buffer=buf, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    size = 8
    while size < GRAM:
        left = h[:-size]
        h = (left ^ (left >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[size:]
        size *= 2
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, limit: int) -> tuple[np.ndarray, ...]:
    """Per anchor: text number, first and last window start (in ``buf``), hash, and its place.  Longer texts come in parts."""
    if len(buf) > limit + length + 8:
        parts = []
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for s in range(a, max(b - length + 1, a), limit):
                e = min(b, s + limit + length - 1)
                got = anchors(np.append(buf[s:e], np.zeros(8, np.uint8)), np.array([0, e - s]), length, limit)
                parts.append((got[0] + d, got[1] + s, got[2] + s, got[3], got[4] + s))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (_NONE, _NONE, _NONE, _NONE.astype(np.uint64), _NONE)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = np.repeat(offsets[:-1], sizes) + spread(sizes)
    if not len(starts):
        return _NONE, _NONE, _NONE, _NONE.astype(np.uint64), _NONE
    h = _gram_hashes(buf)
    key = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
    least = _sliding_min(key, length - GRAM + 1)
    at = (_POS - (least[starts] & _POS)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    return owner[first], starts[first], starts[last], mix(h[at[first]]), at[first]


_SPOT = "g long, ctx long, key long, lo int, hi int, spot int"


def _spots(g, ctx, key, lo, hi, spot) -> list[pa.Array]:
    """Arrays of the columns of ``_SPOT``: group, hash of the context, text, first and last window, anchor's place from ``lo`` on."""
    return [*(pa.array(np.asarray(x).view(np.int64)) for x in (g, ctx, key)), *(pa.array(np.asarray(x).astype(np.int32)) for x in (lo, hi, spot))]


def _anchor_table(rows: DataFrame, length: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                buf, offsets = text_bytes(piece.column("text"))
                owner, lo, hi, h, at = anchors(buf, offsets, length, 2 * PIECE_BYTES)
                ctx, keys, begin = hash_spans(buf, lo, hi + length), np.asarray(piece.column("key")), offsets[owner]
                yield pa.RecordBatch.from_arrays(_spots(h, ctx, keys[owner], lo - begin, hi - begin, at - lo), names=["g", "ctx", "key", "lo", "hi", "spot"])

    return stage(arrow_map(rows, find, _SPOT), "anchors")


def _settled(table: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Intervals ``key, s, e`` of the contexts that repeat whole, and one context of each kind of the groups with several kinds
    (``g, ctx, key, lo, hi, spot, big``: is its group too large for a shard?)."""
    known = table.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.min("ctx").alias("x"), F.max("ctx").alias("y")).where("many > 1").select("g", (F.col("x") != F.col("y")).alias("mixed"))
    live = stage(table.join(known, "g"), "live-contexts")
    rep = F.min(F.struct("key", "lo", "hi", "spot")).alias("rep")
    each = stage(live.groupBy("g", "ctx").agg(F.count(F.lit(1)).alias("many"), F.first("mixed").alias("mixed"), rep), "contexts-known")
    whole = live.join(each.where("many > 1").select("g", "ctx"), ["g", "ctx"]).select("key", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    whole = stage(whole, "whole-contexts")
    unstage(live)
    kinds = each.where("mixed").select("g", "ctx", "rep.*")
    sizes = kinds.groupBy("g").agg((F.sum(F.col("hi") - F.col("lo") + length) > GROUP_BYTES).alias("big"))
    wanted = stage(kinds.join(sizes, "g"), "wanted")
    unstage(each)
    return whole, wanted


_CONTEXT = "g long, big boolean, key long, lo int, spot int, body binary"


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted contexts with their bytes, cut from the texts.  Equal rows are reduced to one before texts meet their contexts."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("g", "big", "lo", "hi", "spot")).alias("spots"))  # at most one a byte of a text
    texts = rows.join(lists.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(lists, "key")

    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                buf, offsets = text_bytes(piece.column("text"))
                spots = piece.column("spots")
                owner = np.repeat(np.arange(piece.num_rows), np.asarray(spots.value_lengths()))
                flat = spots.flatten()
                lo, hi = (np.asarray(flat.field(c)).astype(np.int64) for c in ("lo", "hi"))
                starts, ends = offsets[owner] + lo, offsets[owner] + hi + length
                key = piece.column("key").take(pa.array(owner))
                for a, b in by_size(ends - starts, PIECE_BYTES):
                    columns = [flat.field(c).slice(a, b - a) for c in ("g", "big", "lo", "spot")]
                    columns.insert(2, key.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([*columns, gathered(buf, starts[a:b], ends[a:b])], names=["g", "big", "key", "lo", "spot", "body"])

    return stage(arrow_map(texts.select("key", "text", "spots"), cut, _CONTEXT), "contexts")


def _halves(contexts: DataFrame, part: int, length: int) -> DataFrame:
    """Parts of ``part`` windows of the contexts, by the place of the anchor in a window: columns of ``_SPOT`` and ``body``."""

    def split(batches):
        for batch in batches:
            for piece in slices(batch, "body", PIECE_BYTES // 4):
                buf, offsets = text_bytes(piece.column("body"))
                g, key, lo, spot = (np.asarray(piece.column(c)).astype(np.int64) for c in ("g", "key", "lo", "spot"))
                windows = np.diff(offsets) - length + 1
                # a window that starts at s has the anchor at place spot - s
                first = (spot - windows + 1) // part
                count = spot // part - first + 1
                owner = np.repeat(np.arange(len(g)), count)
                block = first[owner] + spread(count)
                near, far = spot[owner] - block * part, spot[owner] - (block + 1) * part + 1
                begin, end = np.maximum(far, 0), np.minimum(near, windows[owner] - 1)
                at = offsets[owner]
                group = mix(hash_spans(buf, at + near, at + far + length) ^ mix(g[owner].view(np.uint64) ^ mix((block * 1024 + part).astype(np.uint64))))
                ctx = hash_spans(buf, at + begin, at + end + length)
                columns = _spots(group, ctx, key[owner], lo[owner] + begin, lo[owner] + end, spot[owner] - begin)
                yield pa.RecordBatch.from_arrays([*columns, gathered(buf, at + begin, at + end + length)], names=["g", "ctx", "key", "lo", "hi", "spot", "body"])

    return stage(arrow_map(contexts.select("g", "key", "lo", "spot", "body"), split, _SPOT + ", body binary"), "halved-contexts")


def shard_repeats(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the body and start in it of each window whose ``length`` bytes start anywhere else among the bodies."""
    sizes = np.diff(offsets)
    t = np.ones(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    at = np.cumsum(sizes + 1) - sizes - 1
    t[np.repeat(at, sizes) + spread(sizes)] = buf[: offsets[-1]].astype(np.uint16) + 2
    t[-1] = 0
    phi, plcp = permuted_lcp(t, suffix_array(t))
    found = np.nonzero(plcp >= length)[0]
    hit = np.zeros(len(t), bool)
    hit[found] = True
    hit[phi[found]] = True
    starts = np.nonzero(hit)[0]
    owner = np.searchsorted(at, starts, side="right") - 1
    inside = starts - at[owner] <= sizes[owner] - length  # a match that runs over a body's end is none
    return owner[inside], (starts - at[owner])[inside]


def _by_suffixes(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats within the groups of ``contexts``; a shard is a run of whole groups of a task."""

    def shard(table: pa.Table) -> pa.RecordBatch:
        buf, offsets = text_bytes(table.column("body"))
        owner, start = shard_repeats(buf, offsets, length)
        key, lo = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("key", "lo"))
        cut = np.nonzero((np.diff(owner) != 0) | (np.diff(start) > length))[0] if len(owner) else _NONE
        first, last = (np.append(0, cut + 1), np.append(cut, len(owner) - 1)) if len(owner) else (_NONE, _NONE)
        spans = (lo[owner[first]] + start[first], lo[owner[last]] + start[last] + length)
        return pa.RecordBatch.from_arrays([pa.array(key[owner[first]]), *(pa.array(x.astype(np.int32)) for x in spans)], names=["key", "s", "e"])

    def find(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for piece in slices(batch, "body", SHARD_BYTES // 4):
                held.append(piece)
                size += int(np.diff(text_bytes(piece.column("body"))[1]).sum())
                if size < SHARD_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                g = np.asarray(table.column("g").combine_chunks())
                ends = np.nonzero(g[1:] != g[:-1])[0]
                if len(ends):  # the last group may go on
                    yield shard(table.slice(0, int(ends[-1]) + 1))
                    held = table.slice(int(ends[-1]) + 1).combine_chunks().to_batches()
                    size = sum(int(np.diff(text_bytes(x.column("body"))[1]).sum()) for x in held)
        if held:
            yield shard(pa.Table.from_batches(held))

    dealt = contexts.select("g", "key", "lo", "body").repartition("g").sortWithinPartitions("g")
    return arrow_map(dealt, find, "key long, s int, e int")


def repeated_intervals(rows: DataFrame, length: int) -> DataFrame:
    """``key, s, e``: byte intervals that cover exactly the repeated strings of ``rows(key, text)``."""
    table = _anchor_table(rows, length)
    whole, wanted = _settled(table, length)
    unstage(table)
    contexts = _contexts(rows, wanted, length)
    found, part = [whole], 1 << (length - GRAM).bit_length()
    while True:
        found.append(stage(_by_suffixes(contexts.where("not big"), length), "repeats"))
        again = wanted.where("big").limit(1).count() > 0
        unstage(wanted)
        if not again:
            break
        part //= 2
        table = _halves(contexts.where("big"), part, length)
        unstage(contexts)
        whole, wanted = _settled(table.drop("body"), length)
        found.append(whole)
        contexts = stage(table.join(wanted.select("g", "ctx", "key", "lo", "big"), ["g", "ctx", "key", "lo"]).select("g", "big", "key", "lo", "spot", "body"), "contexts")
        unstage(table)
    unstage(contexts)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    out = stage(every, "intervals")
    for table in found:
        unstage(table)
    return out


def _cut_out(buf: np.ndarray, offsets: np.ndarray, owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes left, their offsets, and the number of removed runs of each text; intervals are ordered by text and start."""
    n = len(offsets) - 1
    edge = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(edge, offsets[owner] + s, 1)
    np.add.at(edge, offsets[owner] + e, -1)
    keep = np.cumsum(edge[:-1]) == 0
    upto = np.maximum.accumulate(offsets[owner] + e) if len(owner) else _NONE
    new = np.append(True, (owner[1:] != owner[:-1]) | ((offsets[owner] + s)[1:] > upto[:-1])) if len(owner) else np.zeros(0, bool)
    left = np.append(0, np.cumsum(keep, dtype=np.int64))[offsets]
    return buf[: len(keep)][keep], left, np.bincount(owner[new], minlength=n)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document (and ``kept``, the remaining bytes)."""
    if length < 2 * GRAM:
        raise ValueError(f"length is at least {2 * GRAM}")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    found = repeated_intervals(rows.select("key", "text"), length)
    lists = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("cut"))  # bounded by the text's length

    def cut(batches):
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                buf, offsets = text_bytes(piece.column("text"))
                lists = piece.column("cut")
                owner = np.repeat(np.arange(piece.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                flat = lists.flatten()
                left, at, n_spans = _cut_out(buf, offsets, owner, *(np.asarray(flat.field(c)).astype(np.int64) for c in "se"))
                sizes, whole = np.diff(offsets), memoryview(left)
                columns = [
                    piece.column("id"),
                    *(pa.array(x, pa.int64()) for x in (sizes, sizes - np.diff(at), n_spans)),
                    pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                ]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(gathered(left, at[:-1], at[1:]))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["kept"] * with_text)

    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return arrow_map(rows.join(lists, "key", "left").select("id", "text", "cut"), cut, schema)

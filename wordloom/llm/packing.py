"""Packing by power-of-two decomposition.

Each document's ids are cut into as many pieces of ``max_len`` (a power of two) as fit and then the binary
decomposition of the rest, largest first.  Each piece is a sequence of its own whose length is a power of two, so
sequences need no padding and cross no documents; sequences of a length are numbered one after another, so
batches of equal length are ranges of ``sequence_id``.

The plan has no shuffle of texts or ids: pieces are made where the text is read, with their number within
their task and length; only counts per task and length are gathered to turn these into global numbers.

Edge cases: null text is empty and packs its end id alone; null or equal ids are packed like others; no rows give no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetools import slices, spread, text_bytes
from .staging import arrow_map, maybe_broadcast, stage
from .tokens import Encoder, vocabulary_path, with_end


def cut_lengths(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece lengths of documents with ``n`` ids, flat, and the number of pieces of each document."""
    powers = max_len >> np.arange(max_len.bit_length())
    times = np.empty((len(n), len(powers)), np.int64)
    times[:, 0] = n // max_len
    times[:, 1:] = (n[:, None] & powers[None, 1:]) > 0
    return np.repeat(np.tile(powers, len(n)), times.reshape(-1)), times.sum(axis=1)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, max_len: int = 2048) -> DataFrame:
    """Per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian unsigned 32-bit)."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len is a power of two")
    tokenizer = tokenizer or vocabulary_path()

    def pack(batches):
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        made = np.zeros(max_len.bit_length(), np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, counts = with_end(*encoder.encode(*text_bytes(piece.column("text"))), end_id)
                lengths, pieces = cut_lengths(counts, max_len)
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(counts)), pieces)
                starts = ends - lengths - (np.cumsum(counts) - counts)[owner]
                power = np.log2(lengths).astype(np.int64)
                rank = np.empty(len(lengths), np.int64)
                order = np.argsort(power, kind="stable")
                sizes = np.bincount(power, minlength=len(made))
                rank[order] = spread(sizes) + np.repeat(made, sizes)
                made += sizes
                raw = ids.astype("<u4")
                at = np.append(0, ends * 4).astype(np.int64)
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(owner)),
                        *(pa.array(x, pa.int64()) for x in (starts, lengths, counts[owner])),
                        pa.array(np.full(len(owner), part), pa.int32()),
                        pa.array(rank, pa.int64()),
                        binary,
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "part", "rank", "ids"],
                )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    made = stage(arrow_map(rows, pack, "doc_id long, start long, length long, doc_tokens long, part int, rank long, ids binary"), "packed")
    counts = stage(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packed-counts")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).select(F.col("length").alias("l_length"), before(Window.orderBy("length"), "n").alias("base"))
    placed = counts.withColumn("ahead", before(Window.partitionBy("length").orderBy("part"), "n")).join(F.broadcast(lengths), F.col("length") == F.col("l_length"))  # as many rows as powers
    placed = placed.select(F.col("length").alias("p_length"), F.col("part").alias("p_part"), (F.col("base") + F.col("ahead")).alias("first"))
    out = made.join(maybe_broadcast(placed, counts.count()), (F.col("length") == F.col("p_length")) & (F.col("part") == F.col("p_part")))
    return out.select(
        F.col("doc_id").alias(id_col), "start", "length", "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )

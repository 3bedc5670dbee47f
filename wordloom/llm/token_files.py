"""Token-id files in patched frame-of-reference blocks, written in document order and read back.

A file (shard) holds about ``SHARD_TOKENS`` ids of consecutive documents: a header, the documents' ids and token counts,
the index of block starts, then blocks of ``BLOCK`` ids.  A block stores its minimum, and the differences packed at
the width of their 90th percentile; larger differences stand in an exception list (positions and whole values).
Tasks write the files themselves to a folder of a file system that all executors reach (through pyarrow's file systems: file, hdfs, s3,
gs), by default in the shared folder, each under a passing name first and then moved, so a task that runs twice leaves one
whole file.  Names order the files.  They are read back by Spark's binary file source.

Order: the texts are range-partitioned and sorted by id (then text) before encoding, so ids are never shuffled.  A document's start is
the sum of the tokens of the files before its own, from their headers, and its offset in its own; one row a file meets in one window.

Edge cases: null text is empty and has only the end id; null ids come first; equal ids are ordered by text, and ranges part them by its
first 64 characters (rows equal in both stay together); a text longer than a file makes a larger file; no rows give no files and
no rows; ids are cast to long.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetools import slices, text_bytes
from .staging import arrow_map, maybe_broadcast, shared_dir, stage
from .tokens import Encoder, vocabulary_path, with_end

BLOCK = 512
SHARD_TOKENS = 1 << 20
PERCENTILE = 0.9
MAGIC = b"WLP1"
_HEAD = struct.Struct("<4sIQQI")  # magic, block size, documents, tokens, blocks
_BLOCK = struct.Struct("<IBHH")  # minimum, width, ids, exceptions


def _blocks(ids: np.ndarray) -> list[bytes]:
    n = len(ids)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(rows, BLOCK)
    base = grid.min(axis=1)
    diff = grid - base[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    level = np.partition(diff, at, axis=1)[:, at]
    width = np.ceil(np.log2(level.astype(np.float64) + 1)).astype(np.int64)
    width[(np.uint64(1) << width.astype(np.uint64)) <= level] += 1
    out: list[bytes] = [b""] * rows
    for w in np.unique(width):
        mine = np.nonzero(width == w)[0]
        for part in np.array_split(mine, -(-len(mine) // 256)):
            d = diff[part]
            over = (d >> np.uint32(w)) > 0 if w < 32 else np.zeros(d.shape, bool)
            bits = np.unpackbits(np.where(over, 0, d).astype("<u4").view(np.uint8).reshape(len(part), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            for k, row in enumerate(part):
                used = min(BLOCK, n - row * BLOCK)
                where = np.nonzero(over[k, :used])[0]
                out[row] = (
                    _BLOCK.pack(int(base[row]), int(w), used, len(where)) + packed[k].tobytes() + where.astype("<u2").tobytes() + (d[k, where] + base[row]).astype("<u4").tobytes()
                )
    return out


def encode_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = _blocks(ids)
    starts = np.append(0, np.cumsum([len(b) for b in blocks])).astype("<u8")
    return b"".join(
        [
            _HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(blocks)),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray(counts, "<u8").tobytes(),
            starts.tobytes(),
            *blocks,
        ]
    )


def tokens_of(content) -> int:
    """Number of ids of a file, from its header."""
    return _HEAD.unpack_from(content)[3]


class Shard:
    """A shard read from its bytes; ``ids(a, b)`` decodes only the blocks that hold ids a to b."""

    def __init__(self, content: bytes) -> None:
        magic, self.block, docs, self.n_tokens, n_blocks = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        null = np.frombuffer(content, np.uint8, docs, at)
        ident = np.frombuffer(content, "<i8", docs, at + docs)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ident)]
        self.counts = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(content, "<u8", n_blocks + 1, at + 17 * docs).astype(np.int64)
        self.content, self.body = content, at + 17 * docs + 8 * (n_blocks + 1)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_tokens if end is None else min(end, self.n_tokens)
        if end <= begin:
            return np.zeros(0, np.uint32)
        lo, hi = begin // self.block, -(-end // self.block)
        heads = [_BLOCK.unpack_from(self.content, self.body + int(p)) for p in self.starts[lo:hi]]
        out = np.zeros((hi - lo, self.block), np.uint32)
        width = np.array([h[1] for h in heads])
        for w in np.unique(width):
            for part in np.array_split(mine := np.nonzero(width == w)[0], -(-len(mine) // 256)):
                size = (self.block * int(w) + 7) // 8
                raw = np.stack([np.frombuffer(self.content, np.uint8, size, self.body + int(self.starts[lo + k]) + _BLOCK.size) for k in part])
                bits = np.unpackbits(raw, axis=1, count=self.block * int(w), bitorder="little").reshape(len(part), self.block, int(w))
                full = np.zeros((len(part), self.block, 32), np.uint8)
                full[:, :, : int(w)] = bits
                out[part] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0] + np.array([heads[k][0] for k in part], np.uint32)[:, None]
        for k, (_, w, _, n_over) in enumerate(heads):
            if n_over:
                at = self.body + int(self.starts[lo + k]) + _BLOCK.size + (self.block * w + 7) // 8
                out[k, np.frombuffer(self.content, "<u2", n_over, at)] = np.frombuffer(self.content, "<u4", n_over, at + 2 * n_over)
        return out.reshape(-1)[begin - lo * self.block : end - lo * self.block]


def _make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def write_token_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> str:
    """Writes the files and returns their folder, a path that every executor reaches (by default a new one in the shared folder)."""
    tokenizer = tokenizer or vocabulary_path()
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    _make_folder(docs.sparkSession, folder)

    def write(batches):
        encoder, part, seq = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        files, base = FileSystem.from_uri(folder)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            names, counts, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            passing, name = f"{base}/.{uuid.uuid4().hex}", f"part-{part:08d}-{seq:08d}.wlp"
            with files.open_output_stream(passing) as out:
                out.write(encode_shard(names, counts, ids))
            files.move(passing, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, counts = with_end(*encoder.encode(*text_bytes(piece.column("text"))), end_id)
                held.append((piece.column("doc_id").to_pylist(), counts, ids.astype(np.uint32)))
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def read_token_shards(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the files of ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wlp").load(folder).select(F.regexp_extract("path", r"(part-\d+-\d+)\.wlp$", 1).alias("name"), "content")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([tokens_of(x.as_buffer()) for x in batch.column("content")], pa.int64())], names=["name", "n"])

    per = stage(arrow_map(files, sizes, "name string, n long"), "token-file-sizes")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = per.select(F.col("name").alias("b_name"), ahead.alias("begin"))
    placed = files.join(maybe_broadcast(begins, per.count()), F.col("name") == F.col("b_name"))

    def read(batches):
        for batch in batches:
            for content, begin in zip(batch.column("content"), batch.column("begin").to_pylist()):
                shard = Shard(content.as_py())
                ids, ends = shard.ids().astype("<u4"), np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict({id_col: pa.array(shard.doc_ids, pa.int64()), "start": pa.array(starts + begin, pa.int64()), "n_tokens": pa.array(shard.counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return arrow_map(placed.select("content", "begin"), read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")

"""Vectorised work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whitespace of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts or binaries (null: empty) followed by 8 zero bytes, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    out = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    if data is not None and len(out) > 8:
        out[:-8] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return out, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of ``batch`` with about ``limit`` bytes of ``column`` each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    for a, b in by_size(sizes, limit):
        yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _A
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``; ``buf`` has 8 spare bytes at its end."""
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) ^ (eight[starts] & _MASK[np.minimum(sizes, 8)]))
    more, k = np.nonzero(sizes > 8)[0], 8
    while len(more):
        h[more] = mix(h[more] ^ (eight[starts[more] + k] & _MASK[np.minimum(sizes[more] - k, 8)]))
        k += 8
        more = more[sizes[more] > k]
    return h


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of an equal non-zero ``kind``; runs end where texts end."""
    n = len(kind)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.nonzero(edge)[0]
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] != 0
    return starts[real], ends[real]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number of words of each text."""
    starts, ends = runs((~SPACE[buf[:-8]]).view(np.uint8), offsets)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``buf[starts[i]:ends[i]]`` as a binary array."""
    sizes = ends - starts
    data = buf[np.repeat(starts, sizes) + spread(sizes)]
    at = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def by_size(sizes: np.ndarray, limit: int):
    """Ranges ``(a, b)`` of neighbours whose sizes add up to about ``limit`` (one at least)."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b

"""Token ids by the ``tokenizers`` library, with ids of repeated pieces of text taken from a bounded cache.

A text is cut only where byte-level BPE's pre-tokenizer always cuts, whatever stands around: before ASCII white space
that follows a character that surely is none, and between a letter and an ASCII character that is none.  Each piece
is encoded by the library once per worker and generation of the cache; the ids of a text are those of its pieces.
Texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from .bytetools import SPACE, hash_spans, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker's cache may hold before it starts anew.
CACHE_PIECES = 1_500_000

#: Pieces joined into one text for the library.
RUN = 5000

_byte = np.arange(256)
_letter = ((_byte | 32) >= ord("a")) & ((_byte | 32) <= ord("z"))
_SOLID, _ALPHA, _END, _LATIN = 1, 2, 4, 8
_TAIL = (_byte >= 0x80) & (_byte < 0xC0)
_TWO = (_byte >= 0xC3) & (_byte <= 0xDF)
_KIND = (
    ((_byte > 0x20) & (_byte < 0x7F)) * _SOLID
    + _letter * _ALPHA
    + (_TAIL | _TWO) * _END
    + ((_byte >= 0xC3) & (_byte <= 0xC8)) * _LATIN
    + SPACE * 16
    + ((_byte < 0x80) & ~_letter) * 32
).astype(np.uint8)
#: Bytes that keep a piece out of the joined texts: white space, or a part of a character that may be some.
_ODD = SPACE | (_byte == 0xC2) | (_byte >= 0xE0) | ((_byte >= 0x1C) & (_byte < 0x20))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kind = _KIND[buf[:-8]]
    n = len(kind)
    cut = np.zeros(n, bool)
    if n > 1:
        prev = kind[:-1].copy()
        # the end of a two-byte character takes its class from the lead, but two of 0xC3 are signs
        pair = np.nonzero(prev[1:] & kind[:-2] & _END)[0]
        lead = kind[pair]
        sign = (buf[pair] == 0xC3) & ((buf[pair + 1] == 0x97) | (buf[pair + 1] == 0xB7))
        prev[pair + 1] = _SOLID | np.where(((lead & _LATIN) > 0) & ~sign, _ALPHA, 0).astype(np.uint8)
        # bits 0 and 1 of prev (solid, letter) meet bits 0 and 1 of what follows (space, other ASCII)
        cut[1:] = (prev & (kind[1:] >> 4) & 3) > 0
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.nonzero(cut)[0]


class Encoder:
    """``encode`` gives the flat ids of all texts and the number of ids of each."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], np.int64)
        return np.array([i for x in got for i in x], np.int32), counts

    def _pieces(self, whole: bytes, starts: np.ndarray, ends: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces.  Joinable ones are encoded in long runs, each after a line feed: that is a token of its
        own there, and lengths in bytes tell which tokens belong to which piece."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        easy, rest = np.nonzero(joinable)[0], np.nonzero(~joinable)[0]
        if len(easy):
            cuts = range(0, len(easy), RUN)
            texts = ["\n" + "\n".join([whole[a:b].decode() for a, b in zip(starts[easy[k : k + RUN]].tolist(), ends[easy[k : k + RUN]].tolist())]) for k in cuts]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            sizes = self.n_bytes[ids]
            at = np.cumsum(sizes) - sizes
            bounds = np.append(0, np.cumsum(ends[easy] - starts[easy] + 1))
            owner = np.searchsorted(bounds, at, side="right") - 1
            real = at != bounds[owner]
            counts[easy] = np.bincount(owner[real], minlength=len(easy))
            parts.append((easy, ids[real]))
        if len(rest):
            ids, counts[rest] = self._library([whole[a:b].decode() for a, b in zip(starts[rest], ends[rest])])
            parts.append((rest, ids))
        at = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for which, ids in parts:
            flat[np.repeat(at[which], counts[which]) + spread(counts[which])] = ids
        return flat, counts

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = buf[:-8].tobytes()
        if not self.byte_level or any(s in whole for s in self.special):
            return self._library([whole[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])])
        starts = piece_starts(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(whole))
        uniq, first, where = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHE_PIECES:
            self._forget()
        found = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == uniq[inside]
        slot = np.empty(len(uniq), np.int64)
        slot[known] = self.slots[found[known]]
        new = np.nonzero(~known)[0]
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            odd = np.append(0, np.cumsum(_ODD[buf[:-8]], dtype=np.int64))
            joinable = (odd[b] == odd[a + 1]) & (~_ODD[buf[a]] | SPACE[buf[a]]) & ~SPACE[buf[b - 1]]
            ids, counts = self._pieces(whole, a, b, joinable)
            slot[new] = len(self.at) - 1 + np.arange(len(new))
            self.at = np.append(self.at, self.at[-1] + np.cumsum(counts))
            self.ids = np.append(self.ids, ids)
            self.keys = np.insert(self.keys, found[new], uniq[new])
            self.slots = np.insert(self.slots, found[new], slot[new])
        piece = slot[where]
        sizes = self.at[piece + 1] - self.at[piece]
        flat = self.ids[np.repeat(self.at[piece], sizes) + spread(sizes)]
        upto = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, offsets)]
        return flat, np.diff(upto)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` appended to each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1

"""Suffix arrays by induced sorting, and permuted longest-common-prefix arrays, in numpy.

Every level of the recursion is sorted by induction.  Where buckets are large (bytes of a text), induction goes bucket by bucket: what
a bucket induces into itself is done in waves (one for each repetition of its symbol), everything else in one step per
bucket, with the order of the scan kept by stable sorts.  Where buckets are small (names of a deeper level, which are
many), the scan goes position by position.  Both give the same array.
"""

from __future__ import annotations

import numpy as np

from .bytetools import spread

#: Mean symbols a bucket from which induction goes bucket by bucket; below, by position.  It decides speed only.
BUCKET_MEAN = 256


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type (smaller than the next suffix).  The last symbol is the unique smallest."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[:-1] < t[1:]
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    at = np.where(differs, np.arange(n), n)
    out = up[np.minimum.accumulate(at[::-1])[::-1]]
    out[-1] = True
    return out


def _put(lists: list[list], t: np.ndarray, found: np.ndarray) -> None:
    """Appends ``found`` to the lists of their symbols, in order."""
    if len(found) == 0:
        return
    symbol = t[found]
    order = np.argsort(symbol, kind="stable")
    symbol, found = symbol[order], found[order]
    cuts = np.append(np.append(0, np.nonzero(symbol[1:] != symbol[:-1])[0] + 1), len(symbol)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        lists[symbol[a]].append(found[a:b])


_NONE = np.zeros(0, np.int64)


def _joined(parts: list) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that ``lms`` (leftmost-smaller positions in order) induces."""
    seeds: list[list] = [[] for _ in range(symbols)]
    large: list[list] = [[] for _ in range(symbols)]
    lower: list[list] = [[] for _ in range(symbols)]
    _put(seeds, t, lms)
    for c in range(symbols):
        wave = _joined(large[c])
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            same = t[before] == c
            _put(large, t, before[~same])
            wave = before[same]
            if len(wave):
                large[c].append(wave)
        start = _joined(seeds[c])
        before = start[start > 0] - 1
        _put(large, t, before[~small[before]])
    lower[t[-1]].append(np.array([len(t) - 1], np.int64))
    for c in range(symbols - 1, -1, -1):
        wave = _joined(lower[c])
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[small[before]]
            same = t[before] == c
            _put(lower, t, before[~same])
            wave = before[same]
            if len(wave):
                lower[c].append(wave)
        back = _joined(large[c])[::-1]
        before = back[back > 0] - 1
        _put(lower, t, before[small[before]])
    return np.concatenate([x for c in range(symbols) for x in (_joined(large[c]), _joined(lower[c])[::-1])])


def _induce_by_position(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """What ``_induce`` gives, by a scan of the array from left to right and one from right to left."""
    n = len(t)
    counts = np.bincount(t, minlength=symbols)
    ends = np.cumsum(counts)
    order = lms[np.argsort(t[lms], kind="stable")]
    per = np.bincount(t[order], minlength=symbols)
    slots = np.full(n, -1, np.int64)
    slots[np.repeat(ends - per, per) + spread(per)] = order
    sa, symbol, is_small = slots.tolist(), t.tolist(), small.tolist()
    heads, tails = (ends - counts).tolist(), ends.tolist()
    for at in sa:  # the list grows to the right of where it is read
        if at > 0 and not is_small[at - 1]:
            c = symbol[at - 1]
            sa[heads[c]] = at - 1
            heads[c] += 1
    for k in range(n - 1, -1, -1):
        at = sa[k] - 1
        if at >= 0 and is_small[at]:
            c = symbol[at]
            tails[c] -= 1
            sa[tails[c]] = at
    return np.array(sa, np.int64)


def _differ(t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each span of ``t`` but the first: is it another string than the one before it?"""
    sizes = ends - starts
    out = sizes[1:] != sizes[:-1]
    same = np.nonzero(~out)[0]
    if len(same):
        size = sizes[same]
        step = spread(size)
        unequal = t[np.repeat(starts[same], size) + step] != t[np.repeat(starts[same + 1], size) + step]
        out[same] = np.logical_or.reduceat(unequal, np.cumsum(size) - size)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``, integers from 0 whose last is the only 0."""
    t = np.ascontiguousarray(t)
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    symbols = int(t.max()) + 1
    induce = _induce if n >= BUCKET_MEAN * symbols else _induce_by_position
    small = _types(t)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    order = induce(t, small, lms, symbols)
    if len(lms) <= 1:
        return order
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # name the substrings from one leftmost-smaller position to the next, in their order; equal strings have equal names
    place = np.searchsorted(lms, order)
    ends = np.append(lms[1:] + 1, n)[place]
    names = np.empty(len(lms), np.int64)
    names[place] = np.append(0, np.cumsum(_differ(t, order, ends)))
    if names.max() < len(lms) - 1:
        order = lms[suffix_array(names)]
    return induce(t, small, order, symbols)


def permuted_lcp(raw: np.ndarray, sa: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in the suffix array (-1: none) and their common prefix, in text order.

    ``raw`` are symbols of two bytes.  Positions of one residue modulo ``stride`` are done at once; each goes on from the
    common prefix of the position before it, less one.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, "<u2")
    padded[:n] = raw
    four = np.ndarray((n + 4,), dtype="<u8", buffer=padded, strides=(2,))
    plcp = np.zeros(n, np.int64)
    for r in range(stride):
        at = np.arange(r, n, stride)
        size = np.maximum(plcp[at - 1] - 1, 0) if r else np.zeros(len(at), np.int64)
        live = np.nonzero(phi[at] >= 0)[0]
        size[phi[at] < 0] = 0
        while len(live):
            a, b = at[live] + size[live], phi[at[live]] + size[live]
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            x = four[a] ^ four[b]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 4, (low > np.uint64(0xFFFF)).astype(np.int64) + (low > np.uint64(0xFFFFFFFF)) + (low > np.uint64(0xFFFFFFFFFFFF)))
            size[live] += np.minimum(same, n - np.maximum(a, b))
            live = live[same == 4]
        plcp[at] = size
    return phi, plcp

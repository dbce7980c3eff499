"""Words of many texts hashed at once: arrays over the bytes of an Arrow batch instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_random = np.random.default_rng(20240229)
_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The final steps of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its hash, its first byte, its end, all over the batch; and for each text, where its words start (one more at the end)."""
    solid = ~_BLANK[raw]
    if not solid.any():
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begins[at] = solid[at]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.flatnonzero(solid)
    sizes = end - first
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(at)) - np.repeat(starts, sizes)
    code = _CODE[_LOWER[raw[at]] if lower else raw[at]]
    hashes = mix(np.add.reduceat(code * powers(int(sizes.max()))[within], starts) + sizes.astype(np.uint64))
    return hashes, first, end, np.searchsorted(first, offsets)


def stems(raw: np.ndarray, first: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: which words are longer, and hashes of their first bytes (lower-cased; never equal to a word's hash)."""
    for size in sizes:
        which = np.flatnonzero(end - first > size)
        code = _CODE[_LOWER[raw[first[which][:, None] + np.arange(size)]]]
        yield which, mix((code * powers(size)[:size]).sum(1, dtype=np.uint64) + np.uint64(1000 + size))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words of one text; for the whole text where it has fewer words; none for no words."""
    n = len(hashes)
    k = min(k, n)
    if not n:
        return hashes
    out = hashes[: n - k + 1].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
    return mix(out + np.uint64(k))

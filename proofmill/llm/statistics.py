"""Statistics of whole texts, transformed so that their spread is roughly normal."""

from __future__ import annotations

import numpy as np

from .hashing import mix, word_hashes

NAMES = ["bytes", "words", "word_length", "word_spread", "upper", "symbols", "digits", "punctuation", "exclaims", "distinct", "top_word", "repeats", "lines", "pairs"]
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|<>{}[]\\^~=_@+/", b"0123456789", b".,;:?'\"()-", b"!", b"\n"], 1):
    _CLASS[list(_chars)] = _k


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group: how many distinct keys, and how often the most frequent one occurs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(g)))
    most = np.zeros(groups, np.int64)
    np.maximum.at(most, g[at], sizes)
    return np.bincount(g[at], minlength=groups), most


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of len(NAMES) numbers for each text; a text without words has defined values too."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kinds = _CLASS[raw]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(doc * 8 + kinds, minlength=n * 8).reshape(n, 8).astype(np.float64)
    hashes, first, end, at = word_hashes(raw, offsets)
    words = np.diff(at).astype(np.float64)
    group = np.repeat(np.arange(n), np.diff(at))
    lengths = (end - first).astype(np.float64)
    total = np.bincount(group, lengths, n)
    square = np.bincount(group, lengths**2, n)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(0, square / np.maximum(words, 1) - mean**2))
    distinct, most = _distinct(group, hashes, n)
    same = group[1:] == group[:-1]
    pair_group = group[1:][same]
    pairs, _ = _distinct(pair_group, mix(hashes[:-1][same] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:][same]), n)
    equal = np.bincount(pair_group, (hashes[1:] == hashes[:-1])[same], n)
    rate = lambda k: np.log((share[:, k] + 0.5) / (size + 1))
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), rate(1), rate(2), rate(3), rate(4), rate(5),
        np.log((distinct + 0.5) / (words + 0.5)), np.log((most + 0.5) / (words + 1)), np.log((equal + 0.5) / (words + 1)),
        np.log((share[:, 6] + 1) / (words + 1)), np.log((pairs + 0.5) / (np.maximum(words - 1, 0) + 0.5)),
    ], 1)

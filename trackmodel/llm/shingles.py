"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures of their sets, in numpy."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; starts anew beyond a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
forget_words = _WORDS.clear


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Lower case for A-Z only; ASCII white space separates.

    Fewer words than ``width``: the whole sequence is one shingle, told apart by its length. No words: none.
    """
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array(list(map(len, split)), np.int64)
    flat = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum()))
    out, at = [], 0
    with np.errstate(over="ignore"):
        if len(flat) >= width:
            h = flat[:len(flat) - width + 1].copy()
            for k in range(1, width):
                h = _mix(h) * _STEP + flat[k:len(flat) - width + 1 + k]
            h = _mix(h + np.uint64(width))
        for words in n.tolist():
            if words >= width:
                out.append(np.unique(h[at:at + words - width + 1]))
            elif words:
                v = flat[at:at + 1].copy()
                for k in range(1, words):
                    v = _mix(v) * _STEP + flat[at + k:at + k + 1]
                out.append(_mix(v + np.uint64(words)))
            else:
                out.append(np.empty(0, np.uint64))
            at += words
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes()).digest()


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and additions of ``count`` hash functions, from a fixed seed."""
    a, b = np.random.default_rng(4).integers(0, 1 << 63, (2, count), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` minima for each non-empty set, as rows."""
    a, b = multipliers(count)
    out = np.empty((len(sets), count), np.uint64)
    if not sets:
        return out
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    with np.errstate(over="ignore"):
        for k in range(count):
            h = flat * a[k] + b[k]
            h ^= h >> np.uint64(32)
            h *= _MIX2
            out[:, k] = np.minimum.reduceat(h, start)
    return out

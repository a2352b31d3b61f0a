"""Byte-pair encoding of many words at once in numpy: ragged symbol arrays, one rank per word and round."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd

from .common import kept_by_worker

_NONE = np.iinfo(np.int32).max
_LOADED: dict[str, "ArrayBpe"] = {}
kept_by_worker(_LOADED.clear)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes take the code points from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ArrayBpe:
    """Merge table of a tokenizer file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.size = max(vocab.values()) + 1
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = pd.Series(left * self.size + right)
        self.result = self.result[~key.duplicated().to_numpy()] if key.duplicated().any() else self.result
        self.index = pd.Index(key.drop_duplicates().to_numpy())
        sym = byte_symbols()
        self.inner = np.array([vocab[c] for c in sym], np.int64)
        self.last = np.array([vocab[c + end] for c in sym], np.int64)
        self.index.get_indexer(np.zeros(1, np.int64))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids (0 for an empty word)."""
        n = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        full = np.flatnonzero(n)
        ends = np.cumsum(n)[full] - 1
        sym[ends] = self.last[flat[ends]]
        who, length = full, n[full]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            start = np.concatenate(([0], np.cumsum(length)[:-1]))
            rank = np.full(len(sym), _NONE, np.int64)
            inside = np.ones(len(sym), bool)
            inside[start + length - 1] = False
            at = np.flatnonzero(inside)
            found = self.index.get_indexer(sym[at] * self.size + sym[at + 1])
            rank[at] = np.where(found < 0, _NONE, found)
            least = np.minimum.reduceat(rank, start)
            over = least == _NONE
            if over.any():
                keep = np.repeat(~over, length)
                done.append((who[over], length[over], sym[~keep]))
                sym, rank = sym[keep], rank[keep]
                who, length, least = who[~over], length[~over], least[~over]
                if not len(who):
                    break
            hit = rank == np.repeat(least, length)
            touching = np.flatnonzero(hit[1:] & hit[:-1])
            if len(touching):  # x x x: in a run of one pair, every second place merges, from the left
                at = np.flatnonzero(hit)
                first = np.concatenate(([True], np.diff(at) > 1))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                hit[at[place % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = self.result[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            start = np.concatenate(([0], np.cumsum(length)[:-1]))
            length = length - np.add.reduceat(gone, start, dtype=np.int64)
            sym = sym[~gone]
        counts = np.zeros(len(words), np.int64)
        for w, k, _ in done:
            counts[w] = k
        place = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(place[-1], np.int64)
        for w, k, s in done:
            ids[np.repeat(place[w], k) + np.arange(len(s)) - np.repeat(np.cumsum(k) - k, k)] = s
        return ids, counts


def array_bpe(path: str) -> ArrayBpe:
    if path not in _LOADED:
        _LOADED[path] = ArrayBpe(path)
    return _LOADED[path]

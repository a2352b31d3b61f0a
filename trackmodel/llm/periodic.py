"""Operator 11: periodic runs of words, found by uniting suffix classes in order of decreasing LCP.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` words and ``MIN_EXPONENT`` periods long,
that no neighbouring word extends.

1. A task numbers the words of its texts (a number is a word of one text, so nothing matches across texts) and
   orders the suffixes by doubling. Only those whose first ``least`` words occur twice take part, ``least`` being
   the smallest LCP that a run can leave: the others stay alone at every step below.
2. Neighbouring suffixes' LCPs are the edges; Kruskal takes them from the largest down and unites the classes of
   their ends with union-find. Each class is an ordered set of positions, and the smaller is put into the larger.
   Positions that become neighbours at level l share exactly l words, so at distance p <= l / (exponent - 1) they
   seed a run with period p: its smallest one, else a position between them would have joined before. The seed at
   a run's first word has the word before unlike the word p later; that gives each run once, without extending.
   Classes in which no two positions are near enough for their largest LCP can hold no seed and are left out.
3. Words in a run, but for its first period, are dropped from the collapsed text.

All in one pass over the documents without a shuffle; memory is bounded by a chunk of text or one text. Null and
empty texts have no words, no runs and an empty collapsed text. Ties for the strongest run go to the smallest start,
then the smallest period. Repeated rows are handled one by one. An empty table gives an empty table. Other columns
are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

MIN_EXPONENT, MIN_LENGTH = 4, 6
RUN = "struct<start:long,length:long,period:long>"


def least_lcp(exponent: int, length: int) -> int:
    """The smallest LCP that a run's first word can have with the word a period later."""
    return min(max(length - p, (exponent - 1) * p) for p in range(1, max(length, 2)))


def least_lcp(exponent: int, length: int) -> int:
    """The smallest LCP that a run's first word can have with the word a period later."""
    return min(max(length - p, (exponent - 1) * p) for p in range(1, length + 1))


def _repeated(words: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` words occur twice (a chance match of hashes may add some, and none is left out)."""
    n = len(words) - width + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = words[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, width):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k:n + k].astype(np.uint64)
    in_order = np.sort(h)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    return np.flatnonzero(twice[at] == h)


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each place, the last place up to it that is marked ``new``."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def lcp_edges(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours ``one, two`` in suffix order with an LCP of ``width`` at least, that LCP, and their class.

    Doubling over the repeated positions; the positions ``width`` after them are ranked too, as their continuations.
    """
    n = len(words)
    pos = _repeated(words, width)
    none = np.empty(0, np.int64)
    if not len(pos):
        return none, none, none, none
    padded = np.concatenate((words, np.zeros(2 * width + 1, np.int64)))  # words are numbered from 1
    pos = np.union1d(pos, pos[pos + width < n] + width)
    keys = [padded[pos + k] for k in range(width)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(pos), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    slot = np.full(n + 1, -1)
    slot[pos] = np.arange(len(pos))
    place = np.empty(len(pos), np.int64)
    place[order] = _firsts(new)
    levels = [(width, place)]
    uses = np.bincount(place, minlength=len(pos))
    left = np.flatnonzero(uses[place] > 1)
    if not len(left):
        return none, none, none, none

    def of(level: np.ndarray, where: np.ndarray) -> np.ndarray:
        at = slot[np.minimum(where, n)]
        return np.where(at >= 0, level[at], -1 - np.minimum(where, n))  # no rank: like nothing else

    while len(left):
        size, level = levels[-1]
        after = of(level, pos[left] + size)
        order = np.lexsort((after, level[left]))
        left, after = left[order], after[order]
        group = level[left]
        start = np.ones(len(left), bool)
        start[1:] = group[1:] != group[:-1]
        new = start.copy()
        new[1:] |= after[1:] != after[:-1]
        level = level.copy()
        level[left] = group + _firsts(new) - _firsts(start)
        levels.append((2 * size, level))
        part = np.cumsum(new) - 1
        left = left[np.bincount(part)[part] > 1]
    order = np.argsort(levels[-1][1])
    near = place[order[:-1]] == place[order[1:]]
    one, two, group = pos[order[:-1][near]], pos[order[1:][near]], place[order[:-1][near]]
    lcp = np.zeros(len(one), np.int64)
    for size, level in reversed(levels):
        lcp[of(level, one + lcp) == of(level, two + lcp)] += size
    open_ = np.ones(len(one), bool)
    for _ in range(width - 1):
        open_ &= padded[one + lcp] == padded[two + lcp]
        lcp[open_] += 1
    return one, two, lcp, group


def runs_of(words: np.ndarray, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start and period. Words are numbered from 1, differently per text."""
    one, two, lcp, group = lcp_edges(words, least_lcp(exponent, length))
    if not len(one):
        return []
    # Classes that can hold a seed: two positions no farther apart than the largest LCP allows.
    ends, of = np.concatenate((one, two)), np.concatenate((group, group))
    order = np.lexsort((ends, of))
    ends, of = ends[order], of[order]
    gap = np.where((of[1:] == of[:-1]) & (ends[1:] > ends[:-1]), ends[1:] - ends[:-1], len(words))
    nearest = np.full(int(group.max()) + 1, len(words))
    np.minimum.at(nearest, of[1:], gap)
    most = np.zeros(len(nearest), np.int64)
    np.maximum.at(most, group, lcp)
    able = (nearest * (exponent - 1) <= most)[group]
    order = np.argsort(-lcp[able], kind="stable")
    one, two, lcp = (x[able][order].tolist() for x in (one, two, lcp))
    top: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def seed(first: int, second: int, level: int) -> None:
        p = second - first
        if p * (exponent - 1) <= level and p + level >= length and (first == 0 or words[first - 1] != words[second - 1]):
            found.append((first, p + level, p))

    for x, y, level in zip(one, two, lcp):
        x, y = root(x), root(y)
        small, large = sets.pop(x, None) or [x], sets.pop(y, None) or [y]
        if len(small) > len(large):
            small, large, x, y = large, small, y, x
        top[x] = y
        sets[y] = large
        for v in small:
            large.insert(bisect_left(large, v), v)
        before = after = None
        for k, v in enumerate(small):  # pairs within either set were neighbours at a higher level already
            at = bisect_left(large, v)
            after = small[k + 1] if k + 1 < len(small) else None
            if at and large[at - 1] != before:
                seed(large[at - 1], v, level)
            if at + 1 < len(large) and large[at + 1] != after:
                seed(v, large[at + 1], level)
            before = v
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; then the smallest start and period."""
    best = None
    for r in runs:  # by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def periodic_runs(docs: DataFrame, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs`` (start, length, period), ``strongest`` (null without runs), ``collapsed``: a row per
    document. Words are what ASCII white space separates, numbered from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches):
        for b in text_chunks(batches, "text"):
            split = [t.split() for t in pc.fill_null(b.column("text").cast(pa.binary()), b"").to_pylist()]
            n = np.array(list(map(len, split)), np.int64)
            flat = list(chain.from_iterable(split))
            words = np.fromiter(map(_Numbers().__getitem__, flat), np.int64, len(flat))
            words = words * len(split) + np.repeat(np.arange(len(split)), n) + 1
            first = np.cumsum(n) - n
            found = runs_of(words, exponent, length)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
            if found:
                start, size, period = np.array(found).T
                text = np.searchsorted(np.cumsum(n), start, "right")
                for i, r in zip(text.tolist(), zip((start - first[text]).tolist(), size.tolist(), period.tolist())):
                    runs[i].append(r)
                step = np.zeros(len(flat) + 1, np.int64)
                np.add.at(step, start + period, 1)
                np.add.at(step, start + size, -1)
                kept = np.cumsum(step)[:-1] == 0
                for i in np.unique(text).tolist():
                    split[i] = list(compress(split[i], kept[first[i]:first[i] + n[i]].tolist()))
            as_struct = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
            best = [dict(zip(("start", "length", "period"), r)) if r else None for r in map(strongest, runs)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n), pa.array(as_struct, pa.list_(struct)), pa.array(best, struct),
                 pa.array([b" ".join(w) for w in split], pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "strongest", "collapsed"])

    out = map_arrow(rows, task, f"id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
    return out.withColumnRenamed("id", id_col)

"""Operator 6: best-fit packing by bin completion with branch and bound.

Documents become token ids and a separator; longer ones are cut into full sequences and a last piece. What
has to be packed is then only how many pieces there are of each length - ``size`` numbers, however many
documents - so the search runs on that histogram and plans sequences by pattern (lengths in it, how often).

Search: the largest piece left is completed with undominated fillings (a filling is dominated when one of
its pieces could be swapped for a larger one that is left and fits); a pattern is used as often as the
counts allow; a branch ends when its waste can no longer beat the incumbent, which starts as best-fit
decreasing. It stops at the lower bound ceil(tokens / size), after ``NODES`` nodes or when no branch is left;
the incumbent holds. The search is a beam, not exhaustive: a node tries ``WIDTH`` fillings at most, exact ones of
three pieces start from the ``FIRST`` largest lengths, and smaller multiples of a pattern are not tried. So above
the lower bound the number of sequences may be larger than need be; at the bound it is the fewest.

Pieces are matched to the plan by their rank among the pieces of their length; ranks come from per-task
counts, so a length that a third of all pieces share is not gathered anywhere. The plan that tasks read is
bounded by ``size`` and ``NODES``, not by the documents.

A null or empty text is one separator. Repeated rows are packed one by one. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from unicodedata import category
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import array_bpe
from .common import kept_by_worker, map_arrow, numbered, ranked, text_chunks, texts_of

#: Nodes of the search, fillings tried at a node, and pieces that are tried as the first of three.
NODES, WIDTH, FIRST = 60_000, 4, 48
#: Parts of words whose ids a task keeps; beyond that it starts anew.
CACHE = 200_000
#: The tokenizer's pattern; {L} and {N} stand for letters and numbers up to Latin Extended.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
ODD = re.compile("[\x1c-\x1f]").search

Filling = tuple[int, ...]


class WordIds:
    """Ids of whole texts as the library's tokenizer gives them; each distinct part of a word is encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are its parts' ids in a row.
    Latin text, which the tokenizer's normal form leaves as it is, is lower-cased, split by its pattern and
    merged many parts at a time. Words with other characters or special strings go to the library as they
    are, and so do whole texts with characters that Python alone counts as white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.bpe = Tokenizer.from_file(path), array_bpe(path)
        kinds = {c: category(c)[0] for c in map(chr, range(0x310))}  # and the marks that lower-casing gives
        letters, numbers = ("".join(re.escape(c) for c, k in kinds.items() if k == x) for x in "LN")
        self.split = re.compile(PATTERN.replace("{L}", letters).replace("{N}", numbers)).findall
        self.beyond = re.compile("[^\x00-\u024f]|<[|]").search
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 2000):
            out += [np.array(e.ids, "<u4").tobytes()
                    for e in self.library.encode_batch_fast(texts[i:i + 2000], add_special_tokens=False)]
        return out

    def _parts(self, text: str) -> list[str]:
        if not self.beyond(text):
            return self.split(text.lower())
        return [p for w in text.split() for p in ([w] if self.beyond(w) else self.split(w.lower()))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [bool(ODD(t)) for t in texts]
        parts = [[] if o else self._parts(t) for t, o in zip(texts, odd)]
        new = set().union(*parts)
        if len(self.parts) + len(new) > CACHE:
            self.parts = {}
        new.difference_update(self.parts)
        other = [w for w in new if self.beyond(w)]
        self.parts.update(zip(other, self._library(other)))
        todo = list(new.difference(other))
        ids, n = self.bpe.encode([w.encode("utf-8") for w in todo])
        flat, end = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        self.parts.update(zip(todo, map(flat.__getitem__, map(slice, [0, *end[:-1]], end))))
        get = self.parts.__getitem__
        return [self._library([t])[0] if o else b"".join(map(get, p)) for t, p, o in zip(texts, parts, odd)]


_WORD_IDS: dict[str, WordIds] = {}
kept_by_worker(_WORD_IDS.clear)


def pieces(docs: DataFrame, tokenizer_path: str, size: int, separator: int, id_col: str, text_col: str,
           with_ids: bool) -> DataFrame:
    """Staged pieces of all documents, numbered among those of their length in a task."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([separator], "<u4").tobytes()

    def cut(batches):
        if tokenizer_path not in _WORD_IDS:
            _WORD_IDS[tokenizer_path] = WordIds(tokenizer_path)
        for b in text_chunks(batches, "text"):
            doc, number, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(_WORD_IDS[tokenizer_path](texts_of(b, "text"))):
                x += end
                for k, at in enumerate(range(0, len(x), 4 * size)):
                    part = x[at:at + 4 * size]
                    doc.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [b.column("id").take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        _WORD_IDS[tokenizer_path].parts = {}  # workers live on; what a task has learned does not

    return numbered(rows, "length", "pieces", cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                    + ", ids array<long>" * with_ids)


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram (``counts[l]`` pieces of length l): patterns and their numbers."""
    size = len(counts) - 1
    room: list[list[tuple[Filling, int]]] = [[] for _ in range(size + 1)]
    there = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(there[length:])
            if len(fits):
                r = length + int(fits[0])
                pattern, n = room[r].pop()
                use = min(n, left)
                if n > use:
                    room[r].append((pattern, n - use))
                there[r] = bool(room[r])
                room[r - length].append((pattern + (length,), use))
                there[r - length] = True
            else:
                each = size // length
                use, rest = divmod(left, each)
                pattern = (length,) * each if use else (length,) * rest
                use = use or 1
                room[size - sum(pattern)].append((pattern, use))
                there[size - sum(pattern)] = True
                left -= len(pattern) * use
                continue
            left -= use
    return [x for r in room for x in r]


def fillings(counts: np.ndarray, room: int, width: int) -> list[Filling]:
    """Undominated sets of pieces for ``room``, the least waste first, larger pieces first."""
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]  # dominates whatever else fits
    has = np.flatnonzero(counts[:room])[::-1]
    if not len(has):
        return [()]
    out: list[Filling] = []
    left = has[(has * 2 >= room)]
    for x in left[counts[room - left] > 0]:
        if x * 2 != room or counts[x] > 1:
            out.append((int(x), int(room - x)))
            if len(out) >= width:
                return out
    for x in has[:FIRST]:
        rest = room - int(x)
        second = has[(has <= min(x, rest - 1)) & (has * 2 >= rest)]
        for y in second[counts[rest - second] > 0]:
            trio = (int(x), int(y), int(rest - y))
            if trio[2] and all(counts[k] >= n for k, n in Counter(trio).items()):
                out.append(trio)
                break
        if len(out) >= width:
            return out
    # Largest first, from each of the largest starts; then no swap for a larger piece may be left.
    for first in has[:width]:
        use: Counter[int] = Counter()
        rest, at = room, int(first)
        while rest > 0:
            fit = np.flatnonzero(counts[1:min(at, rest) + 1]) + 1
            fit = [k for k in fit[::-1][:8] if counts[k] > use[int(k)]]
            if not fit:
                break
            at = int(fit[0])
            n = min(rest // at, int(counts[at]) - use[at])
            use[at] += n
            rest -= n * at
            at = at - 1 if counts[at] == use[at] else at
            if at == 0:
                break
        pattern = tuple(sorted(use.elements(), reverse=True))
        swap = rest and any(counts[x + 1:x + rest + 1].any() and any(
            counts[y] > use[y] for y in range(x + 1, x + rest + 1)) for x in use)
        if not swap or not out:
            out.append(pattern)
    return sorted(set(out), key=lambda f: (room - sum(f), [-x for x in f]))[:width]


def plan(counts: np.ndarray, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Patterns and how often each is used, as few sequences as found for the histogram."""
    size = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    full = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    tokens = int((counts * np.arange(size + 1)).sum())
    if not tokens:
        return full
    incumbent = best_fit(counts)
    fewest, least = sum(n for _, n in incumbent), -(-tokens // size)
    path: list[tuple[Filling, int, list[Filling], int]] = []  # pattern, uses, what to try instead, waste before
    waste, used, left = 0, 0, tokens
    while nodes > 0 and fewest > least:
        nodes -= 1
        go_back = False
        if not left:
            if used < fewest:
                incumbent, fewest = [(p, n) for p, n, _, _ in path], used
            go_back = True
        else:
            allowed = (fewest - 1) * size - tokens
            largest = int(np.flatnonzero(counts)[-1])
            counts[largest] -= 1
            todo = [(largest, *f) for f in fillings(counts, size - largest, WIDTH)]
            counts[largest] += 1
            todo = [f for f in todo if waste + size - sum(f) <= allowed or sum(f) == left]
            go_back = not todo
        while go_back and path:
            pattern, n, todo, waste = path.pop()
            for x in pattern:
                counts[x] += n
            used, left = used - n, left + n * sum(pattern)
            go_back = not todo
        if go_back:
            break
        pattern, todo = todo[0], todo[1:]
        n = min(int(counts[x]) // k for x, k in Counter(pattern).items())
        path.append((pattern, n, todo, waste))
        for x in pattern:
            counts[x] -= n
        used, left, waste = used + n, left - n * sum(pattern), waste + n * (size - sum(pattern))
    return full + incumbent


def places(patterns: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """For each length, consecutive ranks (``key`` = length << 40 | first rank) and where they go."""
    out: dict[str, list[int]] = {k: [] for k in ("key", "rank", "each", "length", "sequence", "offset")}
    seen: Counter[int] = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            for k, v in zip(out, (length << 40 | seen[length], seen[length], each, length, sequence, offset)):
                out[k].append(v)
            seen[length] += n * each
            offset += length * each
        sequence += n
    order = np.argsort(np.array(out["key"], np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``), a row per piece."""
    cut = pieces(docs, tokenizer_path, size, separator, id_col, text_col, with_ids)
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r[0]] = r[1]
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, nodes)))
    rows = ranked(cut, "length").drop("part", "local")
    names = [c for c in rows.columns if c != "rank"]

    def place(batches):
        p = shared.value
        for b in batches:
            if b.num_rows:
                length = b.column("length").to_numpy(zero_copy_only=False)
                rank = b.column("rank").to_numpy(zero_copy_only=False)
                at = np.searchsorted(p["key"], length << 40 | rank, "right") - 1
                copy, slot = np.divmod(rank - p["rank"][at], p["each"][at])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.array(p["sequence"][at] + copy), pa.array(p["offset"][at] + slot * length)],
                    [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(rows, place, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)

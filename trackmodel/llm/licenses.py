"""Operator 13: license scans by a generalised suffix automaton of licence tokens.

1. The templates' and phrases' words are numbered and put into one suffix automaton (a few thousand states; its
   size follows the templates, never the documents). A state knows where its words stand in every template.
2. A task streams the words of its texts through the automaton, which gives matching statistics: the longest
   stretch of template words that ends at each word. A word outside the templates takes the automaton back to its
   root, so only stretches of template words are streamed.
3. Phrases are places where the stretch ends with the phrase (read off the state). For templates, matches of
   ``MIN_MATCH`` words or more that the next word does not extend are chained: in order in text and template,
   ``MAX_GAP`` words apart at most in either. A chain that covers ``MIN_COVER`` of its template's words is a span.

All in one pass over the documents without a shuffle; memory is bounded by a chunk of text or one text. Null and
empty texts have no words, places or spans and score 0. Texts are scanned whole, a single very long word included.
Equally good chains: the first to end, then the first to start. Repeated rows are scanned one by one. An empty table
gives an empty table. Other columns are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.9

# --- fixed values: public licence notices, by label ---
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": [
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "gpl": [
        "licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "reserved": ["All rights reserved"],
}
PHRASES: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: ASCII other than letters and digits separates words; A-Z are lower-cased.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over numbered words: every word sequence within some text is a path from 0."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)
        #: For each state and text, where the state's longest sequence ends in it.
        self.ends: list[dict[int, set[int]]] = [defaultdict(set) for _ in self.len]
        for t, text in enumerate(texts):
            state = 0
            for i, c in enumerate(text):
                state = up = self.next[state][c]
                while up > 0:
                    self.ends[up][t].add(i + 1)
                    up = self.link[up]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest sequence of ``p`` followed by ``c``, cut off from longer ones if need be."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        own = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def ancestors(self, state: int) -> list[int]:
        out = []
        while state > 0:
            out.append(state)
            state = self.link[state]
        return out


class Scanner:
    """Templates and phrases as an automaton, and the scan of one stretch of template words."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int = MIN_MATCH,
                 max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        texts = [(label, words_of(t.encode())) for label, ts in sorted(templates.items()) for t in ts]
        texts = [(label, w) for label, w in texts if w]
        spoken = [(label, words_of(p.encode())) for p, label in sorted(phrases.items())]
        self.number: dict[bytes, int] = {}
        coded = [[self.number.setdefault(w, len(self.number)) for w in ws] for _, ws in [*texts, *spoken]]
        self.labels, self.size = [label for label, _ in texts], [len(w) for _, w in texts]
        self.least = [min(min_match, n) for n in self.size]
        self.max_gap, self.min_cover = max_gap, min_cover
        self.shortest = min([len(w) for w in coded], default=1)
        self.machine = m = SuffixAutomaton(coded)
        spoken_at: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for (label, ws), code in zip(spoken, coded[len(texts):]):
            state = 0
            for c in code:
                state = m.next[state][c]
            if ws:
                spoken_at[state].append((len(ws), label))
        #: Per state: phrases that end there, and for each template the deepest sequence found in it (None: all of the
        #: match, else its length) with its ends.
        self.spoken = [[p for up in m.ancestors(s) for p in spoken_at[up]] for s in range(len(m.len))]
        self.within: list[list[tuple[int, int | None, list[int]]]] = []
        for s in range(len(m.len)):
            seen: dict[int, tuple[int, int | None, list[int]]] = {}
            for up in m.ancestors(s):
                for t, ends in m.ends[up].items():
                    if t < len(texts) and t not in seen:
                        seen[t] = (t, None if up == s else m.len[up], sorted(ends))
            self.within.append(list(seen.values()))

    def scan(self, codes: list[int], at: int, places: list, matches: dict[int, list]) -> None:
        """Adds the phrases' ``places`` (start, end, label) and the templates' ``matches`` (start in the text, start
        in the template, length) of one stretch of known words that begins at word ``at``."""
        state = length = 0
        before: dict[int, tuple[int, list[int]]] = {}
        for i, c in enumerate(codes, at + 1):
            state, length = self.machine.step(state, length, c)
            for n, label in self.spoken[state]:
                if n <= length:
                    places.append((i - n, i, label))
            now = {}
            for t, deep, ends in self.within[state]:
                n = length if deep is None else min(deep, length)
                if n >= self.least[t]:
                    now[t] = (n, ends)
            self._close(before, now, i - 1, matches)
            before = now
        self._close(before, {}, at + len(codes), matches)

    def _close(self, before: dict, now: dict, end: int, matches: dict[int, list]) -> None:
        for t, (n, ends) in before.items():
            if t not in now or now[t][0] != n + 1:
                matches[t] += [(end - n, e - n, n) for e in ends]
            elif len(now[t][1]) < len(ends):  # some of its places went on, these did not
                on = {e - 1 for e in now[t][1]}
                matches[t] += [(end - n, e - n, n) for e in ends if e not in on]

    def chains(self, template: int, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """``covered, start, end`` of the best chain that ends with each match."""
        matches = sorted(set(matches))
        best: list[tuple[int, int, int]] = []  # covered words, minus start of the chain, end
        for k, (d, t, n) in enumerate(matches):
            top = (n, -d)
            for j in range(k - 1, -1, -1):
                d2, t2, n2 = matches[j]
                if d2 < d - self.max_gap - self.size[template]:
                    break
                over = max(d2 + n2 - d, t2 + n2 - t, 0)
                if over < n and d - d2 - n2 <= self.max_gap and t - t2 - n2 <= self.max_gap and t2 < t and d2 < d:
                    top = max(top, (best[j][0] + n - over, best[j][1]))
            best.append((*top, d + n))
        return [(c, -s, e) for c, s, e in best]

    def spans(self, matches: dict[int, list]) -> tuple[list[tuple[str, int, int, float]], float]:
        """``label, start, end, covered share`` of accepted chains (of one template, apart), and the best share."""
        out, top = [], 0.0
        for t, found in sorted(matches.items()):
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(self.chains(t, found), key=lambda c: (-c[0], c[2], c[1])):
                share = covered / self.size[t]
                top = max(top, share)
                if share < self.min_cover:
                    break
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    out.append((self.labels[t], start, end, share))
        return sorted(out, key=lambda s: (s[1], s[2], s[0])), top


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, places`` (start, end, label: phrases word for word), ``spans`` (label, start, end, covered:
    templates), ``score`` (the best share of a template or phrase): a row per document. Words count from 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])

    def task(batches):
        scanner = Scanner(templates, phrases, min_match, max_gap, min_cover)
        for b in text_chunks(batches, "text"):
            split = [words_of(t) for t in pc.fill_null(b.column("text").cast(pa.binary()), b"").to_pylist()]
            n = np.array(list(map(len, split)), np.int64)
            stop = np.cumsum(n)
            flat = np.fromiter(map(scanner.number.get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
            places, matches = [[] for _ in split], [defaultdict(list) for _ in split]
            known = np.flatnonzero(flat >= 0)
            text = np.searchsorted(stop, known, "right")
            cut = np.flatnonzero((np.diff(known) > 1) | (np.diff(text) > 0)) + 1
            starts, ends = np.concatenate(([0], cut)), np.append(cut, len(known))
            long = np.flatnonzero(ends - starts >= scanner.shortest) if len(known) else []
            for k in long:
                lo, hi = known[starts[k]], known[ends[k] - 1] + 1
                i = int(text[starts[k]])
                scanner.scan(flat[lo:hi].tolist(), int(lo - (stop[i] - n[i])), places[i], matches[i])
            spans, scores = zip(*map(scanner.spans, matches))
            scores = [1.0 if p else s for p, s in zip(places, scores)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n),
                 pa.array([[dict(zip(("start", "end", "label"), p)) for p in sorted(ps)] for ps in places], pa.list_(place)),
                 pa.array([[dict(zip(("label", "start", "end", "covered"), s)) for s in ss] for ss in spans], pa.list_(span)),
                 pa.array(scores, pa.float64())], ["id", "n_words", "places", "spans", "score"])

    out = map_arrow(rows, task, f"id {kind}, n_words long, places array<struct<start:long,end:long,label:string>>, "
                                "spans array<struct<label:string,start:long,end:long,covered:double>>, score double")
    return out.withColumnRenamed("id", id_col)

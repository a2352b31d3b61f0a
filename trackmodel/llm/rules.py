"""Operator 7: quality rules as a short-circuit cascade ordered by rejection per cost.

On a bounded sample each rule's seconds per document and share of rejected documents are measured; rules
then run in order of rejected share per second, and a document leaves the cascade at the first rule that
rejects it. A document is kept when no rule rejects it, so the order changes only the cost, never the
verdict. The sample (``SAMPLE`` documents at most) decides nothing else.

Features are computed over whole texts in numpy, many documents at a time; no shuffle. Null text: no
words. Words are maximal runs without ASCII white space. Repeated rows are judged one by one; an empty
table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks, texts_of

#: Documents the order of the rules is estimated on, at most.
SAMPLE = 400
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


class Features:
    """Features of a batch of texts, each computed when a rule or a column first asks for it."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self._memo: dict[str, np.ndarray] = {}

    def take(self, at: np.ndarray) -> "Features":
        out = Features([self.texts[i] for i in at])
        out._memo = {k: v[at] for k, v in self._memo.items()}
        return out

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._memo:
            found = getattr(self, f"_{name}")()
            self._memo |= found if isinstance(found, dict) else {name: found}
        return self._memo[name]

    def _each(self, f: Callable[[str], int]) -> np.ndarray:
        return np.fromiter(map(f, self.texts), np.int64, len(self.texts))

    def _word_chars(self):
        return self._each(lambda t: len(t) - sum(map(t.count, BLANKS)))

    def _n_symbols(self):
        return self._each(lambda t: sum(map(t.count, SYMBOLS)))

    def _n_words(self):
        return self._each(lambda t: len(t.encode("utf-8", "surrogatepass").split()))

    def _lines(self):
        total, dup = [], []
        for t in self.texts:
            lines = [x for x in t.split("\n") if x.strip(BLANKS)]
            total.append(len(lines))
            dup.append(len(lines) - len(set(lines)))
        return {"n_lines": np.array(total, np.int64), "n_dup_lines": np.array(dup, np.int64)}

    def _n_lines(self):
        return self._lines()

    def _n_dup_lines(self):
        return self._lines()

    def _n_repeat_words(self):
        split = [t.encode("utf-8", "surrogatepass").split() for t in self.texts]
        n = np.array(list(map(len, split)), np.int64)
        words = [w for s in split for w in s]
        memo = {"n_words": n, "n_repeat_words": np.zeros(len(n), np.int64)}
        if len(words) < 3:
            return memo
        doc = np.repeat(np.arange(len(n)), n)
        code = pd.factorize(np.array(words, object))[0].astype(np.int64)
        pair = pd.factorize((code[:-1] << 31) | code[1:])[0].astype(np.int64)
        triple = pd.factorize((pair[:-1] << 31) | code[2:])[0].astype(np.int64)
        start = np.flatnonzero(doc[2:] == doc[:-2])
        window = pd.factorize((doc[start] << 40) | triple[start])[0]
        again = start[np.bincount(window)[window] >= 2]
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[again + k] = True
        memo["n_repeat_words"] = np.bincount(doc[hit], minlength=len(n)).astype(np.int64)
        return memo

    def _n_upper(self):
        return self._each(lambda t: sum(map(str.isupper, t)))

    def _n_letters(self):
        return self._each(lambda t: sum(map(str.isalpha, t)))


#: A rule: its name, and what it rejects. Integer arithmetic only, so verdicts are exact.
RULES: dict[str, Callable[[Features], np.ndarray]] = {
    "few_words": lambda f: f.n_words < 50,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words,
    "word_length": lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words),
    "duplicate_lines": lambda f: (f.n_lines >= 4) & (10 * f.n_dup_lines > 6 * f.n_lines),
    "few_letters": lambda f: 10 * f.n_letters < 5 * f.word_chars,
    "shouting": lambda f: 10 * f.n_upper > 6 * f.n_letters,
}
#: The contract's own rules.
BASE = ("few_words", "repeated_words")
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rejected(f: Features, order: list[str], rules: dict[str, Callable] = RULES) -> np.ndarray:
    """Short circuit: each rule sees only what the rules before it let through."""
    out = np.zeros(len(f.texts), bool)
    left = np.arange(len(f.texts))
    for name in order:
        if not len(left):
            break
        bad = rules[name](f)
        out[left[bad]] = True
        keep = np.flatnonzero(~bad)
        left = left[keep]
        if bad.any():
            f = f.take(keep)
    return out


def rule_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               rules: dict[str, Callable] = RULES) -> list[str]:
    """Rules by rejected share per second on a bounded sample; a tie keeps the order they are listed in."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"))
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(8)) == 0).select("text").limit(SAMPLE)

    def measure(batches):
        for b in text_chunks(batches, "text"):
            texts = texts_of(b, "text")
            for name, rule in rules.items():
                began = time.perf_counter()
                bad = int(rule(Features(texts)).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([bad]), pa.array([time.perf_counter() - began])], ["rule", "bad", "s"])

    got = map_arrow(rows, measure, "rule string, bad long, s double").groupBy("rule").agg(F.sum("bad"), F.sum("s"))
    gain = {r[0]: (r[1] + 0.01) / (r[2] + 1e-9) for r in got.collect()}
    return sorted(rules, key=lambda name: -gain.get(name, 0.0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None,
                  columns: tuple[str, ...] = BASE_COLUMNS, rules: dict[str, Callable] = RULES) -> DataFrame:
    """``id_col``, the feature ``columns`` of every document, ``base_failed`` and ``kept``."""
    order = order or rule_order(docs, id_col, text_col, rules)
    base = [r for r in BASE if r in rules]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(batches):
        for b in text_chunks(batches, "text"):
            f = Features(texts_of(b, "text"))
            shown = [pa.array(getattr(f, c), pa.int64()) for c in reversed(columns)][::-1]
            failed = np.zeros(len(f.texts), bool)
            for name in base:
                failed |= rules[name](f)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *shown, pa.array(failed), pa.array(~rejected(f, order, rules))],
                ["id", *columns, "base_failed", "kept"])

    shown = "".join(f"{c} long, " for c in columns)
    out = map_arrow(rows, judge, f"id {kind}, {shown}base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)

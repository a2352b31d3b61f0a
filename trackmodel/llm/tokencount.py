"""Operator 10: token counts by rank-synchronous merging of ragged numpy arrays.

A task splits its texts into pre-tokens, merges those it has not met before all together (each round
applies every pre-token's own lowest-rank pair) and sums the counts of surviving symbols per document.
No shuffle; memory is bounded by a chunk of text, one batch of new pre-tokens and a cache of ``CACHE``
counts.

Null and empty texts have 0 bytes and 0 tokens. Long texts are counted whole. Repeated rows are counted
one by one. An empty table gives an empty table. Other columns are neither read nor returned, so their
names cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import array_bpe
from .common import kept_by_worker, map_arrow, text_chunks, texts_of

#: The pre-token pattern of byte-level vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Counts of pre-tokens a task keeps; beyond that it starts anew.
CACHE = 300_000


class _Counter:
    def __init__(self, path: str):
        import regex

        self.bpe, self.known = array_bpe(path), {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.bpe.specials)) or r"(?!)")

    def __call__(self, texts: list[str]) -> list[int]:
        pieces, extra = [], [0] * len(texts)
        for i, t in enumerate(texts):
            words = None
            if any(s in t for s in self.bpe.specials):
                parts = self.special.split(t)
                extra[i] = len(parts) - 1
                words = [w for p in parts for w in self.split(p)]
            pieces.append(self.split(t) if words is None else words)
        new = set().union(*pieces)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
        new = list(new.difference(self.known))
        if new:
            self.known.update(zip(new, self.bpe.encode([w.encode("utf-8") for w in new])[1].tolist()))
        get = self.known.__getitem__
        return [sum(map(get, p)) + e for p, e in zip(pieces, extra)]


_COUNTERS: dict[str, _Counter] = {}
kept_by_worker(_COUNTERS.clear)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens), a row per document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokens(batches):
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = _Counter(tokenizer_path)
        counter = _COUNTERS[tokenizer_path]
        for b in text_chunks(batches, "text"):
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(b.column("text")), 0), pa.int64())
            n_tokens = pa.array(counter(texts_of(b, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])
        counter.known = {}  # workers live on; what a task has learned does not

    out = map_arrow(rows, tokens, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Operator 12: alignment of two tokenizers over the same bytes, with an identity map as fast path.

1. A task encodes each text with both tokenizers and lays the tokens' ends on one byte axis. Ends that both have
   cut the tokens into groups; between two neighbouring ends of either lies exactly one overlapping pair (a link).
2. Identity map: an array gives for each A id the B id with the same bytes. Links of such pairs (the exact
   one-to-one groups) are counted in vectors as long as the vocabulary; only links of irregular groups go on as
   pairs, distinct within a document, into the pair shuffle that counts the documents that hold them.
3. Every document's links are scored with the counts: the vectors and the ``HEAD`` most used pairs at most (chosen
   by a count bound) are broadcast, the other pairs are joined with the pair table by a shuffle and summed per
   document, so every link is scored. No pair of that shuffle is hot: the hot ones are broadcast.

Texts are encoded once and in whole; what the second step needs is staged. A document that is null or empty, or whose
tokens' bytes differ from the space and the text, has no tokens: zeros and an empty group text. Repeated rows are
documents of their own. Ties for an A id's best count are all best. An empty table gives an empty table.
Other columns are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import kept_by_worker, map_arrow, staged, text_chunks, texts_of, unstage
from .tokencount import PATTERN

#: Pairs that may be broadcast with their counts, 16 bytes each.
HEAD = 500_000


class ByteTokenizer:
    """A byte-level vocabulary file. Encodes without special tokens; their strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, value = spec["model"]["vocab"], {c: i for i, c in enumerate(byte_symbols())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes: list[bytes | None] = [None] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(value[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made == sorted(made):  # ids follow the merges' order, so they are ranks
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b is not None}
            self._one = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            self._one = lambda t: library.encode(t, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]


class PieceTokenizer:
    """A sentence-piece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._library = SentencePieceProcessor(model_file=path)
        pieces = [(self._library.id_to_piece(i), self._library.is_byte(i)) for i in range(self._library.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if b else p.replace("▁", " ").encode("utf-8") for p, b in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._library.encode(texts, num_threads=1)


def identity_map(a_bytes: list[bytes | None], b_bytes: list[bytes]) -> np.ndarray:
    """For each A id the B id of the same bytes (-1: none; a whole piece goes before a single byte's stand-in)."""
    of: dict[bytes, int] = {}
    for i, b in enumerate(b_bytes):
        of[b] = i  # whole pieces come after the stand-ins
    return np.array([of.get(b, -1) if b else -1 for b in a_bytes], np.int64)


class Aligner:
    """Both tokenizers and the arrays made from them; one per worker and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokenizer(a_path), PieceTokenizer(b_path)
        self.same = identity_map(self.a.bytes, self.b.bytes)
        self.a_len, self.b_len = (np.array([len(x or b"") for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.size = max(len(self.a_len), len(self.b_len))
        ids = [str(i) for i in range(self.size)]
        self._shown = np.array([i + end for end in (",", "|", ";", "") for i in ids], object)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; none where the bytes of one are not those of space and text."""
        a_ids, b_ids = self.a.encode(texts), self.b.encode(texts)
        for i, t in enumerate(texts):
            raw = b" " + t.encode("utf-8")
            if not t or b"".join(map(self.b.bytes.__getitem__, b_ids[i])) != raw or b"".join(
                    map(self.a.bytes.__getitem__, a_ids[i])) != raw:
                a_ids[i], b_ids[i] = [], []
        return a_ids, b_ids

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text: ``n_a, n_b, n_groups, n_links``, ``groups`` text, and all links (``doc, a, b``)."""
        a_ids, b_ids = self.tokens(texts)
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        axis = int(a_end[-1]) if len(a) else 0
        is_a, is_b = np.zeros(axis + 1, bool), np.zeros(axis + 1, bool)
        is_a[a_end], is_b[b_end] = True, True
        ends = np.flatnonzero(is_a | is_b)
        a_cut, b_cut = is_a[ends], is_b[ends]
        both = a_cut & b_cut
        link_a, link_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        group = np.cumsum(both) - both
        a_group, b_group = group[a_cut], group[b_cut]
        doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
        count = int(both.sum())
        a_in, b_in = np.bincount(a_group, minlength=count), np.bincount(b_group, minlength=count)
        # The text of the groups: A tokens of a group, then its B tokens, each followed by its separator.
        a_done, b_done = np.cumsum(a_in), np.cumsum(b_in)
        show = np.empty(len(a) + len(b), np.int64)
        a_last = np.arange(len(a)) == a_done[a_group] - 1
        b_last = np.arange(len(b)) == b_done[b_group] - 1
        show[np.arange(len(a)) + (b_done - b_in)[a_group]] = a + self.size * a_last
        show[np.arange(len(b)) + a_done[b_group]] = b + 2 * self.size * b_last
        stop = np.cumsum(n_a + n_b)
        full = stop[(n_a + n_b) > 0] - 1
        show[full] = show[full] % self.size + 3 * self.size
        shown = self._shown[show].tolist()
        n_groups = np.bincount(doc[both], minlength=len(texts))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
                "groups": ["".join(shown[e - n:e]) for e, n in zip(stop.tolist(), (n_a + n_b).tolist())],
                "doc": doc, "a": a[link_a], "b": b[link_b]}


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
kept_by_worker(_ALIGNERS.clear)


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _ragged(key: np.ndarray, doc: np.ndarray, docs: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct ``key`` of each document, and how often: two list arrays."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    uses = np.diff(np.append(first, len(key)))
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=docs)))).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array(key[first])),
            pa.ListArray.from_arrays(offsets, pa.array(uses.astype(np.int32))))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
            digest: bool = False) -> DataFrame:
    """``row, id, n_a, n_b, n_groups, n_links, groups`` and a document's distinct links, identical ones (``same``)
    apart from the others (``pairs``), each with its number of uses. ``digest``: SHA-256 instead of the group text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches):
        from pyspark import TaskContext

        own = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for c in text_chunks(batches, "text"):
            got = own.align(texts_of(c, "text"))
            n, doc, a, b = c.num_rows, got["doc"], got["a"], got["b"]
            plain = own.same[a] == b
            texts = got["groups"]
            if digest:
                texts = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), c.column("id"), *[pa.array(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")],
                 pa.array(texts, pa.string()), *_ragged(a[plain].astype(np.int32), doc[plain], n),
                 *_ragged((a[~plain] << 32) | b[~plain], doc[~plain], n)],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "same", "same_n", "pairs", "pairs_n"])
            row += n

    return map_arrow(rows, task, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
                                 "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>")


def identity_counts(found: DataFrame) -> DataFrame:
    """``a, docs``: documents that hold each A id linked with the B id of its bytes. A vector per task, then sums."""
    def task(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(b.column("same").flatten().to_numpy(zero_copy_only=False))
            n[:len(total)] += total[:len(n)]
            total = np.concatenate((n, total[len(n):]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["a", "docs"])

    return map_arrow(found.select("same"), task, "a int, docs long").groupBy("a").agg(F.sum("docs").alias("docs"))


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair`` (A id, then B id in the low half), ``docs``: documents that hold each irregular pair linked."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def _vector(df: DataFrame) -> np.ndarray:
    """(a, value) rows as an array over the vocabulary, which bounds it."""
    got = df.toArrow()
    out = np.zeros(int(got[0].to_numpy().max(initial=-1)) + 2, np.int64)
    out[got[0].to_numpy()] = got[1].to_numpy()
    return out


def _head(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs used most with their counts, in order: all whose count reaches a bound that keeps them few."""
    level = F.floor(F.log2("docs") * 4).cast("int")
    bound, sofar = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        sofar += r[1]
        if sofar > size:
            break
        bound = r[0]
    if bound is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = counts.filter(level >= bound).toArrow()
    order = np.argsort(got["pair"].to_numpy())
    return got["pair"].to_numpy()[order], got["docs"].to_numpy()[order]


def _value(vector: np.ndarray, at: np.ndarray) -> np.ndarray:
    return vector[np.minimum(at, len(vector) - 1)]


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: bool = False, head_size: int = HEAD) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: a row per document.

    A pair's count: documents of the corpus that hold it linked. ``n_best``: links whose count is the highest that
    their A id has in the corpus. ``groups``: ``a1,a2|b1;a3|b2,b3`` in ids, or its SHA-256.
    """
    found = staged(aligned(docs, a_path, b_path, id_col, text_col, digest), "aligned")
    plain = staged(identity_counts(found), "identity")
    pairs = staged(pair_counts(found), "pairs")
    by_a = pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), "docs").unionByName(plain)
    best = staged(by_a.groupBy("a").agg(F.max("docs").alias("docs")), "best")
    shared = found.sparkSession.sparkContext.broadcast((_vector(plain), _vector(best), *_head(pairs, head_size)))

    def task(batches):
        same_docs, best_docs, keys, docs_of = shared.value
        for b in batches:
            n = b.num_rows
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def add(doc, uses, count, a):
                np.add.at(total, doc, uses * count)
                np.add.at(top, doc, uses * (count == _value(best_docs, a)))

            def flat(name):
                return (np.repeat(np.arange(n), np.diff(b.column(name).offsets.to_numpy())),
                        b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                        b.column(f"{name}_n").flatten().to_numpy(zero_copy_only=False).astype(np.int64))

            doc, a, uses = flat("same")
            add(doc, uses, _value(same_docs, a), a)
            doc, pair, uses = flat("pairs")
            at = np.searchsorted(keys, pair)
            hot = np.zeros(len(pair), bool)
            inside = at < len(keys)
            hot[inside] = keys[at[inside]] == pair[inside]
            add(doc[hot], uses[hot], docs_of[at[hot]], pair[hot] >> 32)
            row, left = b.column("row").to_numpy(), ~hot
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.nulls(n, pa.int64()), pa.array(total), pa.array(top)], ["row", "pair", "total", "top"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[doc[left]]), pa.array(pair[left]), pa.array(uses[left]), pa.nulls(int(left.sum()), pa.int64())],
                ["row", "pair", "total", "top"])

    lists = found.select("row", "same", "same_n", "pairs", "pairs_n")
    parts = staged(map_arrow(lists, task, "row long, pair long, total long, top long"), "scores")
    rest = parts.filter("pair is not null").join(pairs, "pair").withColumn("a", F.shiftright("pair", 32).cast("int"))
    rest = rest.join(F.broadcast(best.withColumnRenamed("docs", "most")), "a").select(  # at most a row per A id
        "row", (F.col("total") * F.col("docs")).alias("total"), F.when(F.col("docs") == F.col("most"), F.col("total")).otherwise(0).alias("top"))
    sums = staged(parts.filter("pair is null").select("row", "total", "top").unionByName(rest).groupBy("row").agg(
        F.sum("total").alias("count_sum"), F.sum("top").alias("n_best")), "sums")
    shared.unpersist()
    for done in (parts, pairs, plain):
        unstage(done)
    out = found.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")

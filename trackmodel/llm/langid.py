"""Operator 9: language by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per (language, bucket) over all learning rows: each task sums in numpy and sends
at most languages x buckets partial counts. The log-probability matrix (bounded by ``MAX_LANGS`` x
``buckets``) is broadcast; tasks gather its rows for the n-grams of a batch of texts and add them up per
text. Log-probabilities are fixed-point integers, so sums do not depend on how rows are batched.

Letters are lower-cased, everything else becomes one blank. A null text, or one without a letter, is
``und`` with score 0, and so is every text when nothing was learned. Rows without a language or without
an id are never learned from; a row without an id counts as not held out. Ties take the first language
in order. Repeated rows are predicted one by one, long texts whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks, texts_of

#: Bound of the matrix that is collected and broadcast: languages, and hash buckets of n-grams.
MAX_LANGS, BUCKETS = 256, 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SCALE = 1 << 20
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-case letter, or a blank."""
    if not _FOLD:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low[0])
        _FOLD.append(out)
    return _FOLD[0]


def _grams(texts: list[str], buckets: int):
    """Per order: bucket of every n-gram, and the number of them in each text."""
    flat = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) + 2 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    flat = _fold()[flat]
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | (doc[1:] != doc[:-1])
    flat, doc = flat[keep].astype(np.uint64), doc[keep]
    for order in ORDERS:
        if len(flat) < order:
            continue
        last = len(flat) - order + 1
        h = flat[:last] + np.uint64(order)
        for k in range(1, order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k:last + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(64 - buckets.bit_length() + 1)
        inside = doc[:last] == doc[order - 1:]
        yield h[inside].astype(np.int64), np.bincount(doc[:last][inside], minlength=len(texts))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
          buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their fixed-point log-probabilities: buckets x languages, the prior last."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r[0] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the matrix would not be bounded")
    langs.sort()
    if not langs:
        return [], np.zeros((buckets + 1, 0), np.int64)

    def count(batches):
        place = {k: i for i, k in enumerate(langs)}
        sums = np.zeros((len(langs), buckets + 1), np.int64)
        for b in text_chunks(batches, "text"):
            lang = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            sums[:, buckets] += np.bincount(lang, minlength=len(langs))
            for h, n in _grams(texts_of(b, "text"), buckets):
                sums[:, :buckets] += np.bincount(np.repeat(lang, n) * buckets + h,
                                                 minlength=len(langs) * buckets).reshape(len(langs), buckets)
        who, what = np.nonzero(sums)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what), pa.array(sums[who, what])],
                                             ["lang", "bucket", "n"])

    total = map_arrow(rows, count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = total.toArrow()
    counts = np.zeros((len(langs), buckets + 1))
    counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    grams = counts[:, :buckets] + SMOOTHING
    logs = np.empty((buckets + 1, len(langs)))
    logs[:buckets] = np.log(grams / grams.sum(1, keepdims=True)).T
    logs[buckets] = np.log(counts[:, buckets] / counts[:, buckets].sum())
    return langs, np.round(logs * SCALE).astype(np.int64)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (posterior probability of the prediction)."""
    langs, logs = model
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = len(logs) - 1
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def score(batches):
        table = shared.value
        for b in text_chunks(batches, "text"):
            texts = texts_of(b, "text")
            sums = np.repeat(table[buckets][None, :], len(texts), 0)
            for h, n in _grams(texts, buckets):
                if len(h):
                    full = np.flatnonzero(n)
                    start = (np.cumsum(n) - n)[full]
                    for k in range(len(langs)):
                        sums[full, k] += np.add.reduceat(table[:, k][h], start)
            names, scores = [], []
            best = sums.argmax(1) if langs else None
            for i, t in enumerate(texts):
                if not langs or not (t[:1].isalpha() or any(map(str.isalpha, t))):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    gap = (sums[i] - sums[i, best[i]]) / SCALE
                    names.append(langs[best[i]])
                    scores.append(float(1 / np.exp(gap).sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "lang_pred", "score"])

    out = map_arrow(rows, score, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: ``id_col, held_out, lang_pred, score``."""
    model = learn(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), lang_col, text_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")

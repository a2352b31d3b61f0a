"""Operator 5: text quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is over characters (order ``ORDER``), so words that trusted text never used still get a fair score.
It is trained on trusted documents: labelled good, and never labelled bad or toxic.

1. Each task counts its distinct n-grams (all rows, and rows of trusted text); sums are shuffled by n-gram.
2. Lower orders count distinct predecessors; discounts come from counts of counts (a few numbers per order).
   For every n-gram that occurs in any document, count tables and context tables are joined level by level:
   probability = discounted count / context total + backoff weight x probability of the shorter n-gram.
3. The ``HEAD`` most frequent n-grams at most (chosen by a count bound) are broadcast as hash and log
   probability; a task adds them up per document. Positions whose n-gram is not among them are sent out as
   (row, n-gram, count) and joined with the sharded table, so every position of every text is scored.
4. Thresholds per language, from its own documents alone that the model has not counted: median of mean log
   loss plus ``FENCE`` and a half times the spread (twice the distance from the lower quartile, so that junk in
   up to half of the texts does not move it), plus ``SHORT`` nats shared by all characters of a text (short
   texts vary more). In the quartiles each trusted document that was kept out of the counts (one in ``ASIDE`` by
   hash of the id) weighs one, and all documents not counted together weigh ``PRIOR`` more: many trusted ones
   settle them, without any the language's own text does, and no size switches.

Log probabilities are fixed-point integers, so sums do not depend on partitioning. Null text is empty; an
empty text has no score (null) and is kept; a language whose documents were all counted has no threshold (null)
and is kept. Without trusted text all scores are alike and all texts are kept. Null ids are never trusted;
a null language is a language of its own. Repeated rows are scored one by one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_side, staged, text_chunks, texts_of, unstage

ORDER = 5
HEAD = 1_000_000
#: Trusted ids that may be broadcast (a long each).
IDS = 1_000_000
#: The fence keeps all labelled-clean documents, counted or kept out, of the test tables at every size (sf0.1: 3,027).
FENCE, SHORT, PRIOR = 2.5, 20.0, 20
#: One trusted document in so many sets thresholds and is not counted.
ASIDE = 5
SCALE = 1 << 16
#: A task merges its n-grams when so many have come in, and as many as it holds.
MERGE = 200_000
#: UTF-8 bytes of text a task turns into n-grams at once: each byte takes some 50 bytes of arrays.
CHUNK = 1 << 18
#: Resolution of the quantiles, in nats per character.
BIN = 1e-3
_PAD = "\n" * (ORDER - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded texts (digits as 0), hash of each n-gram's place, places per text."""
    flat = np.frombuffer("".join(f"{_PAD}{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    flat[(flat >= 48) & (flat <= 57)] = 48
    last = len(flat) - ORDER + 1
    h = flat[:last].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k:last + k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return flat, h[place].view(np.int64), n


class _Sums:
    """Distinct n-grams of a task with their counts; memory follows the distinct ones."""

    def __init__(self):
        self.parts, self.size, self.least = [], 0, 0

    def add(self, flat: np.ndarray, h: np.ndarray, n: np.ndarray, trusted: np.ndarray) -> None:
        code, seen = pd.factorize(h)
        first = np.full(len(seen), -1, np.int64)
        start = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
        place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(h))
        first[code[::-1]] = place[::-1]
        grams = np.stack([flat[first + k] for k in range(ORDER)], 1)
        uses = np.bincount(code, minlength=len(seen))
        good = np.bincount(code[np.repeat(trusted, n)], minlength=len(seen))
        self.parts.append((seen, grams, uses, good))
        self.size += len(seen)
        if self.size > self.least + max(MERGE, self.least):
            self.merge()

    def merge(self) -> None:
        columns, self.parts = [list(x) for x in zip(*self.parts)][::-1], []
        joined = lambda: np.concatenate(columns.pop())  # noqa: E731  a column's parts go as it is joined
        code, seen = pd.factorize(joined())
        first = np.empty(len(seen), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        grams = joined()[first]
        sums = [np.bincount(code, joined(), len(seen)).astype(np.int64) for _ in range(2)]
        self.parts, self.size = [(seen, grams, *sums)], len(seen)
        self.least = len(seen)


def _count(docs: DataFrame) -> DataFrame:
    """``gram, h, uses, c``: all n-grams of all texts, their uses, and their uses in trusted text."""
    def count(batches):
        sums = _Sums()
        for b in text_chunks(batches, "text", CHUNK):
            flat, h, n = _codes(texts_of(b, "text"))
            sums.add(flat, h, n, np.array(b.column("role").to_pylist()) == 1)
        if not sums.parts:
            return
        sums.merge()
        seen, grams, uses, good = sums.parts[0]
        for i in range(0, len(seen), 50_000):
            part = grams[i:i + 50_000].astype("<u4")
            text = part.tobytes().decode("utf-32-le", "surrogatepass")
            names = [text[k:k + ORDER] for k in range(0, len(text), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seen[i:i + 50_000]),
                                              pa.array(uses[i:i + 50_000]), pa.array(good[i:i + 50_000])], ["gram", "h", "uses", "c"])

    sums = map_arrow(docs.select("text", "role"), count, "gram string, h long, uses long, c long")
    return staged(sums.groupBy("gram", "h").agg(F.sum("uses").alias("uses"), F.sum("c").alias("c")), "grams")


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n = {r[0]: r[1] for r in level.filter("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """``gram, lp`` for every n-gram of ``grams`` (gram, c; c: uses in trusted text), lp x ``SCALE`` an integer."""
    levels = {ORDER: grams.filter("c > 0").select(F.col("gram").alias("g"), "c")}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels[k] = staged(shorter, f"level{k}") if k > 1 else shorter
    asked = {ORDER: grams.select(F.col("gram").alias("g"))}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = staged(asked[k + 1].select(F.substring("g", 2, k).alias("g")).distinct(), f"asked{k}")
    base = 1.0 / (levels[1].count() + 1)
    done = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[k])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = levels[k].groupBy(F.substring("g", 1, k - 1).alias("ctx")).agg(
            F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("back"))
        rows = asked[k].select("g", F.substring("g", 1, k - 1).alias("x"), F.substring("g", 2, k - 1).alias("short"))
        rows = rows.join(levels[k].withColumnRenamed("g", "lg"), F.col("g") == F.col("lg"), "left")
        rows = rows.join(context, F.col("x") == F.col("ctx"), "left")
        if done is None:
            rows = rows.withColumn("less", F.lit(base))
        else:
            rows = rows.join(done.select(F.col("g").alias("dg"), F.col("p").alias("less")), F.col("short") == F.col("dg"))
        own = F.coalesce(F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        done = staged(rows.select("g", F.when(F.col("total").isNull(), F.col("less")).otherwise(
            own + F.col("back") * F.col("less")).alias("p")), f"p{k}")
    return done.select(F.col("g").alias("gram"), F.round(F.ln("p") * SCALE).cast("long").alias("lp"))


def _head(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log probabilities of the n-grams used most: all whose uses reach a bound that keeps them few."""
    level = F.floor(F.log2("uses") * 4).cast("int")
    bound, sofar = None, 0
    for r in table.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        sofar += r[1]
        if sofar > size:
            break
        bound = r[0]
    if bound is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = table.filter(level >= bound).select("h", "lp").toArrow()
    return got["h"].to_numpy(), got["lp"].to_numpy()


def losses(docs: DataFrame, table: DataFrame, head_size: int = HEAD) -> DataFrame:
    """``docs`` (id, h, lang, text, role) without its text, with ``n`` places and ``lp``, their summed log probability."""
    shared = docs.sparkSession.sparkContext.broadcast(_head(table, head_size))
    kind = docs.schema["id"].dataType.simpleString()

    def score(batches):
        from pyspark import TaskContext

        keys, values = shared.value
        index = pd.Index(keys)
        row = TaskContext.get().partitionId() << 40
        for b in text_chunks(batches, "text", CHUNK):
            flat, h, n = _codes(texts_of(b, "text"))
            at = index.get_indexer(h) if len(keys) else np.full(len(h), -1)
            known = at >= 0
            value = np.where(known, values[at] if len(keys) else 0, 0)
            rows = row + np.arange(len(n))
            row += len(n)
            sums = np.add.reduceat(value, np.cumsum(n) - n)
            none = pa.nulls(len(n), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), b.column("id"), b.column("h"), b.column("lang"), b.column("role"),
                 pa.array(n - 1), pa.array(sums), none, pa.nulls(len(n), pa.int64())], names)
            rest = np.flatnonzero(~known)
            if len(rest):
                doc = np.repeat(np.arange(len(n)), n)[rest]
                start = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
                place = (start - (np.cumsum(n) - n))[doc] + rest
                grams = np.stack([flat[place + k] for k in range(ORDER)], 1).astype("<u4")
                text = grams.tobytes().decode("utf-32-le", "surrogatepass")
                left = pd.DataFrame({"row": rows[doc], "gram": [text[k:k + ORDER] for k in range(0, len(text), ORDER)]})
                left = left.groupby(["row", "gram"], sort=False).size().reset_index(name="k")
                m = len(left)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left["row"].to_numpy(np.int64)), pa.nulls(m, b.column("id").type), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.array(left["gram"].tolist(), pa.string()), pa.array(left["k"].to_numpy(np.int64))], names)

    names = ["row", "id", "h", "lang", "role", "n", "lp", "gram", "k"]
    out = staged(map_arrow(docs, score, f"row long, id {kind}, h long, lang string, role int, n long, lp long, "
                                        "gram string, k long"), "scores")
    shared.unpersist()  # the scores are written: no task reads the table any more
    rest = out.filter("gram is not null").select("row", "gram", "k").join(table.select("gram", F.col("lp").alias("g_lp")), "gram")
    rest = rest.groupBy("row").agg(F.sum(F.col("k") * F.col("g_lp")).alias("more"))
    return out.filter("gram is null").drop("gram", "k").join(rest, "row", "left").withColumn(
        "lp", F.col("lp") + F.coalesce("more", F.lit(0))).drop("more", "row")


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """Per language: median loss of its documents that were not counted, plus the fence."""
    got = scored.filter("role <> 1 and n > 0").groupBy("lang", F.floor(F.col("loss") / BIN).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("role") == 2, 1)).alias("trusted")).collect()
    langs: dict[str, list[tuple[int, int, int]]] = {}
    for lang, b, n, t in got:
        langs.setdefault(lang, []).append((b, n, t))
    out = {}
    for lang, bins in langs.items():
        each = PRIOR / sum(n for _, n, _ in bins)
        total, sofar, quartile = PRIOR + sum(t for _, _, t in bins), 0.0, {}
        for b, n, t in sorted(bins):
            sofar += t + n * each
            for q in (0.25, 0.5):
                if sofar >= q * total - 1e-9 and q not in quartile:
                    quartile[q] = (b + 1) * BIN
        spread = 2 * (quartile[0.5] - quartile[0.25])
        out[lang] = quartile[0.5] + spread / 2 + FENCE * max(spread, 10 * BIN)
    return out


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``t_id`` of documents that some label calls good and none calls bad or toxic."""
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    good = F.max(F.coalesce("quality", F.lit(0)) == 1)
    ids = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("t_id")).agg(good.alias("good"), bad.alias("bad"))
    return ids.filter("good and not bad").select("t_id")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             head_size: int = HEAD) -> DataFrame:
    """``id_col, perplexity`` (per character), ``threshold, kept``, and ``text_hash``; a row per document."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    known = small_side(trusted.withColumn("trusted", F.lit(True)), IDS)
    base = base.withColumn("h", F.xxhash64("text")).join(known, F.col("id") == F.col("t_id"), "left").select(
        "id", "h", "lang", "text", F.when(F.col("trusted").isNull(), 0).when(
            F.pmod(F.xxhash64(F.lit("aside"), F.col("id").cast("string")), F.lit(ASIDE)) == 0, 2).otherwise(1).alias("role"))
    grams = _count(base)
    lp = staged(grams.select("gram", "h", "uses").join(log_probabilities(grams), "gram"), "model")
    unstage(grams)
    loss = F.when(F.col("n") > 0, -F.col("lp") / F.lit(float(SCALE)) / (F.col("n") + 1))
    scored = losses(base, lp, head_size).withColumn("loss", loss)
    by_lang = _thresholds(scored)
    limit: Column = F.lit(None).cast("double")
    if by_lang:
        limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(by_lang.items()) for x in kv]), F.col("lang"))
    limit = limit + SHORT / (F.col("n") + 1)
    return scored.select(
        F.col("id").alias(id_col), F.exp("loss").alias("perplexity"), F.exp(limit).alias("threshold"),
        F.coalesce(F.col("loss") <= limit, F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))

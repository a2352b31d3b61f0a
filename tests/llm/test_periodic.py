"""Periodic runs against a direct search of every period, and the query against its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from trackmodel.llm import periodic, queries


def brute(words, exponent=4, least=6):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i - start + q
            if n >= max(least, exponent * q) and not any(
                    words[start:start + n - p] == words[start + p:start + n] for p in range(1, q)):
                out.append((start, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (2, 6)])
def test_runs_of_many_texts_at_once(exponent, least):
    rng = random.Random(exponent * 10 + least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 3))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        flat, want = [], []
        for i, words in enumerate(texts):
            want += [(s + len(flat), n, q) for s, n, q in brute(words, exponent, least)]
            flat += [w * len(texts) + i + 1 for w in words]
        assert periodic.runs_of(np.array(flat, np.int64), exponent, least) == want, texts


def test_long_texts_of_few_words():
    one = periodic.runs_of(np.ones(50_000, np.int64))
    assert one == [(0, 50_000, 1)]
    period = np.concatenate((np.arange(1, 701), np.tile(np.arange(701, 1001), 50), [1001]))
    assert periodic.runs_of(period) == [(700, 15_000, 300)]


def test_strongest_compares_exactly():
    assert periodic.strongest([(0, 9, 2), (4, 18, 4), (9, 13, 3)]) == (0, 9, 2)
    assert periodic.strongest([]) is None


def test_collapsed_text_and_nulls(spark):
    rows = [(1, "x a b a b a b a b\ty"), (2, None), (3, ""), (4, " one word \x0b z\x1cz "), (5, "g " * 7)]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(1, 8, 2)] and got[1]["collapsed"] == "x a b y"
    assert got[2]["n_words"] == 0 and got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[2]["strongest"] is None
    assert got[3]["collapsed"] == "" and got[4]["collapsed"] == "one word z\x1cz" and got[4]["n_words"] == 2
    assert tuple(got[5]["strongest"]) == (0, 7, 1) and got[5]["collapsed"] == "g"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark):
    seen = 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_periodic_runs(spark, SF).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        code = {}
        runs = brute([code.setdefault(w, len(code)) for w in words])
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1] * 10**9 // x[2], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == _sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == _sha(" ".join(w for i, w in enumerate(words) if i not in gone))
        seen += bool(runs)
    assert seen >= 5


def test_query_schema(spark):
    out = queries.op11_periodic_runs(spark, SF)
    assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
        "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert out.filter(F.col("runs_sha256").isNull() | F.col("collapsed_sha256").isNull()).count() == 0

"""License scans: automaton against direct search, base places by brute force, planted and altered notices."""

import random
import re

from tests.llm.conftest import SF
from trackmodel.llm import licenses, queries


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_are_the_pattern_s():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 _-.\n\x00\x7f@[`{éÉ日🙂 \x85") for _ in range(40))
        assert [w.decode() for w in licenses.words_of(t.encode())] == words(t)


def test_automaton_gives_the_longest_match():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        machine = licenses.SuffixAutomaton(texts)
        inside = lambda s: any(t[i:i + len(s)] == s for t in texts for i in range(len(t)))
        stream = [rng.randint(0, 3) for _ in range(60)]
        state = length = 0
        for i, c in enumerate(stream):
            state, length = machine.step(state, length, c)
            assert length == max(n for n in range(i + 2) if n == 0 or inside(stream[i + 1 - n:i + 1]))
            if state:
                found = {(t, e) for t, ends in machine.ends[state].items() for e in ends}
                own = stream[i + 1 - length:i + 1]
                assert found == {(t, e) for t, x in enumerate(texts) for e in range(length, len(x) + 1) if x[e - length:e] == own}


def matches_of(scanner, text):
    """All maximal common stretches of a text and each template, by direct search."""
    out = set()
    for t, size in enumerate(scanner.size):
        flat = [words_ for ts in sorted(licenses.TEMPLATES.items()) for words_ in map(words, ts[1])][t]
        w = words(text)
        for d in range(len(w)):
            for k in range(size):
                n = 0
                while d + n < len(w) and k + n < size and w[d + n] == flat[k + n]:
                    n += 1
                # the longest stretch that ends there, in this template
                if n >= scanner.least[t] and not any(
                        d - b >= 0 and e - n - b >= 0 and w[d - b:d + n] == flat[e - n - b:e]
                        for b in (1,) for e in range(n, size + 1)):
                    out.add((t, d, k, n))
    return out


def test_matches_against_direct_search():
    from collections import defaultdict

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    rng = random.Random(9)
    vocabulary = sorted(w.decode() for w in scanner.number)
    whole = [t for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(25):
        text = " ".join(rng.choice([*rng.sample(vocabulary, 4), " ".join(words(rng.choice(whole))[rng.randint(0, 5):rng.randint(6, 14)])])
                        for _ in range(12))
        codes = [scanner.number[w.encode()] for w in words(text)]
        found = defaultdict(list)
        scanner.scan(codes, 0, [], found)
        got = {(t, *m) for t, ms in found.items() for m in ms}
        assert matches_of(scanner, text) <= got
        flat = [words(t) for _, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
        assert all(words(text)[d:d + n] == flat[t][k:k + n] for t, d, k, n in got)


def scan(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan_licenses(df, **kw).collect(), key=lambda r: r["doc_id"])]


def test_planted_notices(spark):
    long = licenses.TEMPLATES["mit"][2]
    w = long.split()
    altered = " ".join(w[:30] + ["inserted", "words"] + w[30:50] + w[52:])
    half = " ".join(w[:len(w) // 2])
    noise = " ".join(f"w{i}" for i in range(40))
    got = scan(spark, [None, "", noise, f"{noise}\n// {long}\n{noise}", f"{noise} {altered} {noise}", half,
                       "Licensed under CC BY-NC 4.0.", "Licensed under the GNU General Public License, Version 2.0",
                       "x" * 100_000 + " released under\nthe mit license " + noise, "cc by cc by", "the of and under this"])
    labels = [sorted({s["label"] for s in r["spans"]}) for r in got]
    assert labels == [[], [], [], ["mit"], ["mit"], [], ["cc-by-nc-4.0"], ["gpl"], ["mit"], [], []]
    assert (got[3]["spans"][0]["start"], got[3]["spans"][0]["end"]) == (40, 40 + len(words(long)))
    assert 0.9 <= got[4]["spans"][0]["covered"] < 1 and 0.4 < got[5]["score"] < 0.6
    assert [(p["start"], p["end"], p["label"]) for p in got[9]["places"]] == [(0, 2, "cc-by"), (2, 4, "cc-by")]
    assert [r["score"] for r in got[:3]] == [0.0, 0.0, 0.0] and got[6]["score"] == got[7]["score"] == 1.0


def test_no_templates(spark):
    got = scan(spark, ["all rights reserved", "x"], templates={}, phrases={"all rights reserved": "r"})
    assert [len(r["places"]) for r in got] == [1, 0]
    assert [r["spans"] for r in scan(spark, ["all rights reserved"], templates={}, phrases={})] == [[]]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    some = 0
    for r in queries.op13_license_scan(spark, SF).collect():
        w, starts, labels = docs[r["doc_id"]], [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"]) == (len(w), len(starts))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        own = r["labels"].split(",") if r["labels"] else []
        assert own == sorted(set(own)) and labels <= set(own) and 0 <= r["score"] <= 1
        some += bool(own)
    assert some

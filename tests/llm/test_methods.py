"""Operators against brute force, exact round trips or held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from trackmodel.llm import chat, decontam, langid, neardup, packing, pii, quality, rules, sharding, shingles, tokencount
from trackmodel.llm.bpe import array_bpe
from trackmodel.llm.common import numbered, ranked

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = list("ab \n\t'sreXÉ  1²½٣Ⅷ中文!\x1c\x1d\x85\xa0éñ\U0001F600́ÀΣσİ@.-+()") + ["<|endoftext|>", "aaaa", "12", "  "]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)] + ["a" * 3000, "", "<|startoftext|>x"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 -----------------------------------------------------------------------------------------------------------------

def test_decontamination_matches_brute_force(spark):
    rng = random.Random(1)
    words = ["the", "of", "Cat", "dog", "É", "é", "x1", "tree"]
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((3, 13, 15, 20, 1, 14, 13))]
    items += [(90, items[3][1]), (91, items[1][1].upper())]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"{rng.choice(words)}, {text}. tree-{words[i % 8]}") for i, (_, text) in enumerate(items)]
    got = {r["doc_id"]: r for r in decontam.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, item_text in items:
            iw = split(item_text)
            for k in range(max(1, len(iw) - 12)):
                window = iw[k:k + 13]
                for p in range(len(w) - len(window) + 1):
                    if w[p:p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))


# 2 -----------------------------------------------------------------------------------------------------------------

def test_sharding_is_even_and_keeps_groups(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.4 else f"t{rng.randint(0, 250)}") for i in range(803)] + [(None, None), (5, "t1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.balanced_shards(docs, [F.md5(F.col("text"))], 8, keep={"text": F.col("text")}).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    places = defaultdict(set)
    for r in out:
        places[r["text"]].add(r["shard"])
    size = Counter(t for _, t in rows)
    cut = sum(len(places[t]) > 1 for t in size if t and t != "hot" and size[t] > 1)
    assert cut <= 0.1 * sum(size[t] > 1 for t in size) and len(places["hot"]) <= 6


def test_quotas_never_overfill():
    rng = random.Random(0)
    for _ in range(200):
        asked = {(a, b): rng.randint(1, 9) for a in range(4) for b in range(4) if a != b and rng.random() < 0.6}
        free, loose = [rng.randint(-3, 3) for _ in range(4)], [rng.randint(0, 5) for _ in range(4)]
        allowed, given = sharding._quotas(asked, free, loose)
        for s in range(4):
            into = sum(n for (_, b), n in allowed.items() if b == s) + sum(n for (_, b), n in given.items() if b == s)
            out = sum(n for (a, _), n in allowed.items() if a == s) + sum(n for (a, _), n in given.items() if a == s)
            assert into - out <= max(0, free[s])
        assert all(n <= asked[k] for k, n in allowed.items())


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 % 3).cast("int").alias("g")).repartition(6)
    rows = ranked(numbered(df, "g", "t"), "g").collect()
    for g in range(3):
        assert sorted(r["rank"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))


# 3 -----------------------------------------------------------------------------------------------------------------

def naive_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for k, pattern, few, many in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if few <= len(d) <= many and (k == 3 or pii.luhn(d)):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    parts = ["1", "25", "255", "0", "4111111111111111", "555-3824", "+1 (743) ", ".", "@", "a", "b-c", " ", "-", "é", "%", "+", "(", "300", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == naive_base(text), text


def test_base_spans_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" * 50_000, "1." * 100_000):
        pii.base_spans(text)


def _best(lattice, weights, moves):
    """Brute force over all segmentations."""
    s = lattice.scores(weights)
    at = defaultdict(list)
    for k, (i, j) in enumerate(lattice.bounds):
        at[i].append((j, k))

    def walk(i, last):
        if i == lattice.n:
            return 0.0
        return max((moves[last, y] + s[k, y] + walk(j, y) for j, k in at[i] for y in range(len(pii.LABELS)) if s[k, y] > -np.inf),
                   default=-np.inf)

    return walk(0, 0)


def test_semi_markov_decoding_and_gradient():
    rng = np.random.default_rng(1)
    text = "call +1 (743) 555-3824 or 1.2.3.4"
    tokens = pii.regions(text)[0][:7]
    lattice = pii.Lattice(text, tokens)
    weights, moves = rng.normal(size=(5, pii.BUCKETS)), rng.normal(size=(5, 5))
    s = lattice.scores(weights)
    where = {b: k for k, b in enumerate(lattice.bounds)}
    got, at, last = 0.0, 0, 0
    found = pii.decode(lattice, weights, moves)
    spans = {i: (j, y) for i, j, y in found}
    while at < lattice.n:
        j, y = spans.get(at, (at + 1, 0))
        got += moves[last, y] + s[where[at, j], y]
        at, last = j, y
    assert math.isclose(got, _best(lattice, weights, moves))
    gold = {(i, i + 1): 0 for i in range(lattice.n)}
    expect, pair = pii._gradient(lattice, gold, weights, moves)
    cover = np.zeros(lattice.n)
    for (i, j), e in zip(lattice.bounds, expect):
        cover[i:j] += e.sum()
    assert np.allclose(cover, 0) and abs(pair.sum() - expect.sum()) < 1e-9


def test_model_adds_what_the_patterns_miss(spark, small):
    model = pii.train(small)
    text = "ring (521) 555-6210 now, thanks; version 2.0 of file 17"
    base, both = pii.all_spans(text, model)
    assert base == [] and [text[a:b] for a, k, b in both if k == 3] == ["(521) 555-6210"]
    rows = small.join(pii.find(small, model), "doc_id").collect()
    for r in rows:
        assert pii.listed(naive_base(r["text"] or "")) == r["base"]
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    clean = pii.redact(small, model).collect()
    assert not any(naive_base(r["text"] or "") for r in clean)


def test_training_finds_the_labels_among_many_numerals(spark):
    plain = [(i, " and ".join(f"item {i * 1000 + k} of {k}.{i}" for k in range(400))) for i in range(60)]
    phones = [(100 + i, f"call +1 ({200 + 7 * i}) 555-{1000 + 13 * i} or ask at desk {i}") for i in range(20)]
    docs = spark.createDataFrame(plain + phones, "doc_id long, text string")
    model = pii.train(docs)
    assert model is not None
    other = pii.train(docs.repartition(7))
    assert all((a == b).all() for a, b in zip(model, other))
    text = "ring (521) 555-6210 now, thanks; version 2.0 of file 17"
    assert [text[a:b] for a, k, b in pii.all_spans(text, model)[1]] == ["(521) 555-6210"]

PROBES = [
    ("write to jane @ example.com now", [("email", "jane @ example.com")]), ("call 555 - 123 - 4567 today", [("phone", "555 - 123 - 4567")]),
    ("at (521)  555-6210 ok", [("phone", "(521)  555-6210")]), ("phone: 5215556210 x", [("phone", "5215556210")]),
    ("tel 521.555.6210.", [("phone", "521.555.6210")]), ("card 4111.1111.1111.1111 ok", [("card", "4111.1111.1111.1111")]),
    ("host 10 . 0 . 0 . 7 up", [("ip", "10 . 0 . 0 . 7")]), ("id 078-05-1120 x", []), ("host 10.0.0.999 y", []),
    ("order 5215556210 items", []), ("in 2021-03-04 we", []), ("x 4111 1111 1111 1112 y", []),
]


def test_regions_span_blanks_punctuation_and_free_at_signs():
    shown = lambda t: [t[r[0][0]:r[-1][1]] for r in pii.regions(t)]
    assert shown("a jane @ example.com b 555 - 123 -  4567 c 1\n2 d") == ["jane @ example.com", "555 - 123 -  4567", "1", "2"]
    assert shown("@") == ["@"] and shown("x @") == ["x @"] and shown("@ y") == ["@ y"] and shown("no seeds") == []
    assert shown("a@b c @d @ e") == ["a@b c @d @ e"]
    for t in ("1 2 3", "(1) 2", "x1 - - 2", "a @ b @ c", "@@ @", "1" * 50, "a   1 \t 2"):
        spans = [s for r in pii.regions(t) for s in r]
        assert spans == sorted(spans) and all(t[a:b].strip() for a, b in spans)


def test_field_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    found = {r["kind"]: r for r in pii.evaluate(docs, model).collect()}
    assert sum(r["hits"] for r in found.values()) >= 8
    for r in found.values():
        assert r["missed"] * 10 <= r["hits"] + r["missed"] and r["wrong"] * 10 <= r["hits"] + r["wrong"], r


def test_field_finds_other_forms_and_leaves_lookalikes(spark):
    """Enough base spans of every kind to learn from; the forms themselves are in no training text."""
    rng = random.Random(8)

    def card():
        body = "".join(str(rng.randint(0, 9)) for _ in range(15))
        number = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return " ".join(number[i:i + 4] for i in range(0, 16, 4))

    make = [lambda: f"{rng.choice('abcdefgh')}{rng.choice(['lex', 'my.b', 'o_k'])}{rng.randint(1, 99)}@{rng.choice(['mail', 'post-x'])}.{rng.choice(['com', 'org'])}",
            lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card,
            lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"]
    words = ["ask", "see", "the", "note", "desk", "at", "or", "about", "item"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{some(5)} {make[i % 4]()}{rng.choice(['', '.'])} {some(4)}") for i in range(600)]
    rows += [(1000 + i, f"{some(4)} {rng.randint(1, 10 ** rng.randint(1, 12))} {some(2)} {rng.randint(1, 2100)}. {some(3)}") for i in range(300)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for text, want in PROBES:
        base, both = pii.all_spans(text, model)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in both if (a, k, b) not in base] == want, text


# 4 -----------------------------------------------------------------------------------------------------------------

def sets_of(text):
    w = lower(text).encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_docs():
    rng = random.Random(6)
    docs, n = [], 0
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
            docs.append((n, " ".join(copy)))
            n += 1
    return docs + [(n, "a b"), (n + 1, "A  b"), (n + 2, "a b c"), (n + 3, None), (n + 4, "")]


def test_near_duplicates_match_brute_force(spark):
    docs = near_docs()
    sets = {i: sets_of(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_blocks_of_a_large_cluster_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    test_near_duplicates_match_brute_force(spark)


def test_estimate_is_close_to_the_similarity():
    rng = random.Random(7)
    a = [f"t{i}" for i in range(600)]
    b = [w if rng.random() > 0.02 else "z" for w in a]
    x, y = shingles.shingle_sets([" ".join(a), " ".join(b)], 5)
    real = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    bits = neardup.pack_bits(shingles.minima([x, y], neardup.HASHES))
    assert abs(neardup.estimate(bits[0], bits[1:])[0] - real) < 0.2


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(301, 300)]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {
        **{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}


def count_staged(monkeypatch):
    """Rows of each table that ``neardup`` stages from now on, by its name."""
    rows, stage = {}, neardup.staged

    def counted(df, name):
        out = stage(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    return rows


def test_edges_of_a_group_are_joined_once(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(40), i) for i in range(40, 400) for _ in range(8)] + [(7, 7), (500, 500), (998, 999), (999, 998)]
    rows = count_staged(monkeypatch)
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    ends = {x for e in edges for x in e}
    assert {r["node"]: r["label"] for r in got} == {i: i if i in (500, 998) else 998 if i == 999 else 0 for i in ends}
    assert sum(rows["edges"]) < 1.5 * len({frozenset(e) for e in edges})


def test_links_of_near_copies_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    words = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join([*words[:-1], f"end{i}"])) for i in range(96)]
    rows = count_staged(monkeypatch)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == len(docs)
    assert sum(rows["links"]) <= 2 * len(docs)


def test_parts_of_blocks_meet_across_blocks(spark, monkeypatch):
    """A chain: each text is near the next alone, and its neighbours mostly are in other blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    docs = [(i, " ".join(f"w{j}" for j in range(10 * i, 10 * i + 160))) for i in range(20)]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == len(docs)


# 5 -----------------------------------------------------------------------------------------------------------------

def test_probabilities_sum_to_one_and_follow_the_recursion(spark):
    text = "the cat sat on the mat and the cat ate the rat " * 3
    padded = "\n" * 4 + text + "\n"
    counts = Counter(padded[i:i + 5] for i in range(len(padded) - 4))
    chars = sorted({g[-1] for g in counts})
    asked = {"he ca"[:4] + c for c in chars} | {"the" + " " + c for c in chars} | {"qqqq" + c for c in chars} | {"zzthe", "zzzzZ"}
    grams = spark.createDataFrame([(g, counts.get(g, 0)) for g in asked | set(counts)], "gram string, c long")
    p = {r["gram"]: math.exp(r["lp"] / quality.SCALE) for r in quality.log_probabilities(grams).collect()}
    rest = 1 / (len(chars) + 1)  # what unknown characters get is a share of the uniform base
    for context in ("he c", "the ", "qqqq"):
        total = sum(p[context + c] for c in chars)
        assert total < 1 and total > 1 - rest

    levels = {5: counts}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(level):
        n = Counter(level.values())
        if not (n[1] and n[2] and n[3]):
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))

    offs = {k: discounts(v) for k, v in levels.items()}

    def prob(g):
        k = len(g)
        if not k:
            return 1 / (len(levels[1]) + 1)
        same = [c for x, c in levels[k].items() if x[:-1] == g[:-1]]
        if not same:
            return prob(g[1:])
        off = lambda c: offs[k][min(c, 3) - 1]
        own = levels[k].get(g, 0)
        return (max(own - off(own), 0) if own else 0) / sum(same) + sum(map(off, same)) / sum(same) * prob(g[1:])

    assert all(math.isclose(p[g], prob(g), rel_tol=1e-3) for g in asked)


def test_broadcast_and_joined_scores_agree_and_junk_goes(spark, small):
    ids = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    a = quality.classify(small, ids).collect()
    b = quality.classify(small, ids, head_size=300).collect()
    c = quality.classify(small.repartition(5), ids, head_size=0).collect()
    key = lambda rows: sorted((r["doc_id"], r["perplexity"], r["kept"]) for r in rows)
    assert key(a) == key(b) == key(c)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in a}
    good = [kept[i] for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0 and i in kept]
    bad = [kept[i] for i, r in labels.items() if r["quality"] == 0 and i in kept]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_a_language_without_labels_is_judged_by_its_own_text(spark, small):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for gone in ("fr", None):
        docs = small.withColumn("lang", F.when(F.col("lang") == "fr", gone).otherwise(F.col("lang")))
        own = {r["doc_id"] for r in small.filter("lang = 'fr'").collect()}
        ids = quality.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet").filter(~F.col("doc_id").isin(list(own))))
        kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, ids).collect()}
        good = [kept[i] for i in own if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
        assert len(good) > 3 and np.mean(good) > 0.9


def test_fence_keeps_clean_text_and_little_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unlabelled = table.join(docs.filter("lang = 'es'").select("doc_id"), "doc_id", "left_anti")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, quality.trusted_ids(unlabelled)).collect()}
    labels = {r["doc_id"]: r for r in table.collect() if r["doc_id"] in kept}
    good = [kept[i] for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [kept[i] for i, r in labels.items() if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.04  # measured: 299 of 299, 1 of 58


# 6 -----------------------------------------------------------------------------------------------------------------

def test_word_ids_are_the_librarys():
    ids, library = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    texts = odd_texts(800)
    for t, x in zip(texts, ids(texts)):
        assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark, small):
    rows = packing.pack(small, WORD, 300, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, t in texts.items():
        own = sorted(parts[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == library.encode(t, add_special_tokens=False).ids + [0]
        assert [r["start"] for r in own] == [300 * k for k in range(len(own))] and all(r["length"] == 300 for r in own[:-1])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 300
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 300) + 2


def _fewest(lengths, size):
    """Exact number of bins for a few pieces."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for r in set(bins):
            if r >= lengths[i]:
                put(i + 1, [*(x for k, x in enumerate(bins) if k != bins.index(r)), r - lengths[i]])
        put(i + 1, [*bins, size - lengths[i]])

    put(0, [])
    return best[0]


def test_plan_uses_every_piece_and_few_sequences():
    rng = random.Random(8)
    for n in (0, 1, 5, 9, 10):
        for _ in range(25):
            size = rng.choice([10, 17, 30])
            lengths = [rng.randint(1, size) for _ in range(n)]
            counts = np.bincount(lengths, minlength=size + 1).astype(np.int64) if n else np.zeros(size + 1, np.int64)
            patterns = packing.plan(counts)
            used = Counter()
            for f, k in patterns:
                assert sum(f) <= size
                for x in f:
                    used[x] += k
            assert used == Counter(lengths)
            assert sum(k for _, k in patterns) == _fewest(lengths, size)


# 7 -----------------------------------------------------------------------------------------------------------------

def test_rule_features_match_brute_force(spark):
    texts = odd_texts(200) + ["a b c a b c a b c", "x\nx\n\n \nx\ny", "a a a a", "w " * 60, "one | two | three"]
    f = rules.Features(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (f.n_words[i], f.word_chars[i], f.n_symbols[i], f.n_repeat_words[i], f.n_dup_lines[i]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(hit), len(lines) - len(set(lines))), t


def test_rule_order_changes_no_verdict(spark, small):
    names = list(rules.RULES)
    a = rules.quality_rules(small, order=names).collect()
    b = rules.quality_rules(small.repartition(3), order=names[::-1]).collect()
    assert sorted(a) == sorted(b) and sorted(rules.rule_order(small)) == sorted(names)
    assert all(not r["kept"] for r in a if r["base_failed"])


# 8 -----------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["<turn ", "</turn>\n", "\\", "\\l", "\\b", "\\g", "<", ">", "user", "\n", "<image 0>", "é", "", "\\### Assistant: </turn> ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys<>tem", None]), "".join(rng.choices(bits, k=rng.randint(0, 6))))
            for c in range(30) for t in range(rng.randint(1, 6))] + [(None, None, "assistant", None), (3, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_conversations(df)).collect():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", chat_escape(x[3] or ""), x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[4]) for x in own]
        assert r["loss_texts"] == [x[4] for x in own if x[2] == "assistant"]


def chat_escape(t):
    return t.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def test_typed_parts(spark):
    row = (1, 0, "user", [("text", "see <", None, None), ("image", None, "s3://a.png", 3), None, ("video", None, "v", 2),
                          ("audio", None, "b.wav", None), (None, "?", None, None), ("text", None, None, None), ("document", None, "c", 2)])
    df = spark.createDataFrame([row], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.read_back(chat.format_conversations(df, parts=F.col("parts"))).first()
    assert r["formatted"] == "<turn user>see \\l<image 0><other 1><audio 2><other 3><document 4></turn>\n"
    assert [(a["place"], a["number"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [
        (0, 0, "image", "s3://a.png", 768), (0, 1, "other", "v", 0), (0, 2, "audio", "b.wav", 25), (0, 3, "other", None, 0),
        (0, 4, "document", "c", 1200)]
    assert r["turns"][0]["text"] == "see <" and r["loss"] == []


# 9 -----------------------------------------------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_scores_match_brute_force(spark):
    train = spark.createDataFrame([("aa bb", "x"), ("ab ba", "x"), ("cc dd", "y"), (None, "y"), ("cd", None)], "text string, lang string")
    langs, logs = langid.learn(train)
    text = "a1c  d"
    grams = Counter()
    for h, _ in langid._grams([text], langid.BUCKETS):
        grams.update(h.tolist())
    assert sum(grams.values()) == sum(len(" a c d ") - k for k in range(3))
    want = [logs[-1, k] + sum(n * logs[g, k] for g, n in grams.items()) for k in range(2)]
    r = langid.predict(spark.createDataFrame([(1, text), (2, "12 !"), (3, None)], "doc_id long, text string"), (langs, logs)).collect()
    assert r[0]["lang_pred"] == langs[int(np.argmax(want))]
    assert math.isclose(r[0]["score"], 1 / sum(math.exp((w - max(want)) / langid.SCALE) for w in want))
    assert [(x["lang_pred"], x["score"]) for x in r[1:]] == [("und", 0.0)] * 2


# 10 ----------------------------------------------------------------------------------------------------------------

def test_token_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(BYTE)
    texts = odd_texts(800) + ["a<|endoftext|> b<|endoftext|>", " " * 700 + "x", "ab" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokencount.count_tokens(df, BYTE, 20).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 20)


def test_array_merging_gives_the_librarys_ids():
    bpe, library = array_bpe(BYTE), Tokenizer.from_file(BYTE)
    words = ["hello", " world", "aaaaaaa", " ", "", "naïve", "\U0001F600"]
    ids, n = bpe.encode([w.encode() for w in words])
    assert n[4] == 0
    for w, part in zip(words, np.split(ids, np.cumsum(n)[:-1])):
        assert part.tolist() == library.encode(w, add_special_tokens=False).ids


# pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, at = docs.columns, docs
    for name, stage in pipeline.STAGES:
        before, at = at, pipeline.staged(stage(spark, at, SF), name)
        if name != "best_fit_packing":
            assert at.columns == columns and at.schema.simpleString() == docs.schema.simpleString()
        ids = [r["doc_id"] for r in at.select("doc_id").distinct().collect()]
        if name == "quality_classifier":
            labels = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
            assert len(labels & set(ids)) >= 0.97 * len(labels & set(texts))
        if name == "minhash_near_dedup":
            sets = [sets_of(texts[i]) for i in ids]
            links = sum(100 * len(x & y) >= 75 * len(x | y) for x, y in itertools.combinations(sets, 2) if x and y)
            assert links == 0
        if name == "pii":
            rows = at.collect()
            assert not any(naive_base(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert len(ids) == before.count()
        if name == "best_fit_packing":
            assert set(ids) == {r["doc_id"] for r in before.collect()}



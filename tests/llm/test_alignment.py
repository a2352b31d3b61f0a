"""Tokenizer alignment against a direct comparison of byte ranges, with the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from trackmodel.llm import align, queries
from trackmodel.llm.bpe import byte_symbols

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def spans(ids, value):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(value(i))))
        at = out[-1][2]
    return out


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    symbol = {c: i for i, c in enumerate(byte_symbols())}
    name = {i: t for t, i in one.get_vocab(with_added_tokens=False).items()}
    a_bytes = lambda i: bytes(symbol[c] for c in name[i])
    b_bytes = lambda i: (bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i)
                         else two.id_to_piece(i).replace("▁", " ").encode())
    links, shown = [], []
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        if t and any(b"".join(map(f, ids)) != b" " + t.encode() for f, ids in ((a_bytes, a), (b_bytes, b))):
            a, b = [], []
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        links.append([(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [[[i for i, s, e in x if lo <= s and e <= hi] for x in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        shown.append((len(a), len(b), len(cuts), ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)))
    held = Counter(p for ls in links for p in set(ls))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, n_g, len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), text)
            for (n_a, n_b, n_g, text), ls in zip(shown, links)]


def texts():
    rng = random.Random(3)
    pool = ["the", "The", "house", "  ", "\n", "\t", "straße", "naïve", "日本語", "🙂", "don't", "12345", "<s>", "</s>",
            "<|endoftext|>", "<0x41>", "aaaa", "zzzzzz", "ing", "▁", "\x00", "ﬁ", "é", "----", "http://x.y/z?q=1"]
    out = [None, "", " ", "a", "a", "▁", "x▁y", "<unk>", "<|endoftext|>", "ab" * 300, "  lead and trail  ", "\r\n\r\n"]
    return out + ["".join(rng.choice(["", " "]) + rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(120)]


@pytest.mark.parametrize("head", [0, 40, align.HEAD])
def test_against_brute_force(spark, head):
    rows = list(enumerate(texts()))
    want = dict(enumerate(brute([t for _, t in rows])))
    got = align.align_corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, head_size=head)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got.collect()} == want
    assert sum(w[0] == 0 for w in want.values()) >= 4


def test_identity_map_prefers_whole_pieces():
    own = align.aligner(A, B)
    pieces = own.b.bytes
    assert all(own.a.bytes[i] == pieces[j] for i, j in enumerate(own.same) if j >= 0)
    assert (own.same >= 0).sum() > 5_000
    letter = own.a.bytes.index(b"e")
    assert not SentencePieceProcessor(model_file=B).is_byte(int(own.same[letter]))


def test_query_against_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert max(len(r["text"] or "") for r in docs) < 1_000_000
    got = {r["doc_id"]: r for r in queries.op12_tokenizer_alignment(spark, SF).collect()}
    short = [r for r in docs if len(r["text"] or "") < 1500]
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    for r, (n_a, n_b, n_groups, n_links, _, _, groups) in zip(short, brute([r["text"] for r in short])):
        g = got[r["doc_id"]]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"]) == (n_a, n_b, n_groups, n_links)
        assert g["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        assert 0 <= g["n_best"] <= g["n_links"] <= g["count_sum"]
    assert set(got) == {r["doc_id"] for r in docs}
    assert list(got[docs[0]["doc_id"]].asDict()) == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

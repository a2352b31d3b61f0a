"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import clash
from trackmodel.llm import (align, decontam, langid, licenses, neardup, packing, periodic, pii, quality, rules, sharding,
                            tokencount)

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (None, "alpha"), (3, ""), (4, "no such words")],
                                 "item_id long, text string")


def labels(spark, ids):
    return spark.createDataFrame([(i, 1, 0) for i in ids] + [(None, 1, None), (7, None, None)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "decontam": lambda s, d: decontam.decontaminate(d, bench(s)),
    "sharding": lambda s, d: sharding.balanced_shards(d, [F.md5(F.col("text"))], 4),
    "pii": lambda s, d: pii.find(d, pii.train(d)),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "quality": lambda s, d: quality.classify(d, quality.trusted_ids(labels(s, range(20)))),
    "packing": lambda s, d: packing.pack(d, WORD, 64),
    "rules": lambda s, d: rules.quality_rules(d),
    "langid": lambda s, d: langid.identify(d),
    "tokens": lambda s, d: tokencount.count_tokens(d, BYTE),
    "periodic": lambda s, d: periodic.periodic_runs(d),
    "align": lambda s, d: align.align_corpus(d, BYTE, PIECE),
    "licenses": lambda s, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_each_get_a_result(spark, edge, name):
    out = OPERATORS[name](spark, clash(edge)).collect()
    rows = [r for r in out if r["piece"] == 0] if name == "packing" else out
    key = lambda i: (i is not None, i)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r["doc_id"] for r in edge.collect()), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_empty_benchmark_and_labels(spark, edge):
    none = decontam.decontaminate(edge, bench(spark).limit(0)).collect()
    assert not any(r["contaminated"] or r["n_hit"] for r in none)
    kept = quality.classify(edge, quality.trusted_ids(labels(spark, []).limit(0))).collect()
    assert len(kept) == edge.count() and all(r["kept"] for r in kept)


def test_filters_keep_columns(spark, edge):
    docs = clash(edge)
    one = neardup.deduplicate(docs)
    assert one.columns == docs.columns
    texts = [r["text"] for r in one.collect()]
    assert texts.count(edge.filter("doc_id = 6").first()["text"]) == 1 and len(texts) == 11
    clean = pii.redact(docs, None)
    assert clean.columns == docs.columns
    assert "[EMAIL] and [PHONE]" in clean.filter("doc_id = 11").first()["text"]
    assert clean.filter("text is null").count() == 1

"""Documents of hot keys in parts: bounded rows, nothing lost, united as if never split."""

import pytest
from pyspark.sql import functions as F

from trackmodel.operators.parts import part_members, unite_parts
from trackmodel.plans.extract import extract_definition
from trackmodel.plans.ingest import ingest
from trackmodel.plans.mapping import parse_definition
from trackmodel.session import scratch_path
from trackmodel.sources.store import CollectionStore

BODY = {"a": "collection", "schema_identifier": "k", "items": {
    "a": "nested_collection", "n_id": "i", "tag": "t", "tuples": {"a": "nested_array", "a_id": "j", "v": "v"}}}


def rows(spark, n):
    """Two thirds of the rows under one key; a null key too."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, F.lit(None).cast("string")).otherwise(
            (F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") % 500).alias("i"), (F.col("id") % 500 % 7).alias("t"), F.col("id").alias("j"), (F.col("id") / 2).alias("v"))


def test_parts_unite_to_the_whole_and_do_not_grow(spark):
    whole, split = (parse_definition("C", dict(BODY, **more)) for more in ({}, {"parts": {"rows": 100}}))
    largest = []
    for n in (3_000, 12_000):
        src = rows(spark, n)
        docs = extract_definition(src, split).cache()
        want = {r["schema_identifier"]: r["items"] for r in extract_definition(src, whole).collect()}
        got = {r["schema_identifier"]: r["items"] for r in unite_parts(docs, "items", "schema_identifier").collect()}
        assert got == want
        largest.append(docs.select(F.max(F.size(F.flatten(F.col("items")["tuples"])))).first()[0])
        assert docs.filter("part_of = 'hot'").count() > n / 100 / 2
        assert docs.filter("parts = 1").filter(~F.col("schema_identifier").eqNullSafe(F.col("part_of"))).count() == 0
        members = part_members(docs, "items")
        assert members.count() == sum(map(len, want.values()))
    assert largest[0] <= 250 and largest[1] <= 250


def test_flat_arrays_slices_and_settings(spark):
    one = parse_definition("C", {"a": "collection", "schema_identifier": "dshs#mapping_all", "tuples": {
        "a": "nested_array", "a_id": "j"}, "parts": {"rows": 50}, "partition": {"interval": "1s", "ts_field": "j"}})
    docs = extract_definition(rows(spark, 2_000), one).collect()
    assert sorted(int(t[0]) for r in docs for t in r["tuples"]) == list(range(2_000))
    assert {r["part_of"] for r in docs} == {"all__1s_1", "all__1s_2"} and max(len(r["tuples"]) for r in docs) < 100
    with pytest.raises(ValueError, match="parts.rows"):
        parse_definition("C", dict(BODY, parts={"rows": 0}))
    with pytest.raises(ValueError, match="one nested"):
        parse_definition("C", {"a": "collection", "schema_identifier": "k", "parts": {"rows": 5}})


def test_import_again_with_more_rows_reads_the_newest_split(spark):
    store = CollectionStore(spark, scratch_path(spark, "t"))
    mapping = {"name": "m", "file": {"format": "json"}, "data": {"C": [dict(BODY, parts={"rows": 100})]}}
    for n in (600, 3_000):
        ingest(spark, mapping, rows(spark, n).filter("k = 'hot'"), store)
    got = unite_parts(store.scan("C"), "items", "schema_identifier").collect()
    whole = extract_definition(rows(spark, 3_000).filter("k = 'hot'"), parse_definition("C", BODY)).first()
    assert [r["items"] for r in got] == [whole["items"]]

"""Broken records, rejects with multiplicity, and types of text leaves."""

import os

import pytest
from pyspark.sql import functions as F

from trackmodel.plans.ingest import MALFORMED, SOURCE, ingest, plan_import
from trackmodel.plans.mapping import parse_mapping
from trackmodel.session import scratch_path
from trackmodel.sources.files import read_source
from trackmodel.sources.store import CollectionStore
from trackmodel.sources.typed import leaf_types, text_leaves

BINS = {"Bins": [{"a": "collection", "schema_identifier": "id", "x": "x"}]}
MORE = dict(BINS, Kinds=[{"a": "collection", "schema_identifier": "kind"}],
            Levels=[{"a": "collection", "schema_identifier": "id", "levels": {"a": "nested_array", "a_id": "x"}}])


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)
    return os.path.join(folder, name)


def _import(spark, fmt, path, data=BINS, store=None, spec=None, **kw):
    mapping = {"name": "bins", "file": {"format": fmt, "delimiter": ";", "header": "True", "timestamp_format": "ms", **(spec or {})},
               "data": data}
    store = store or CollectionStore(spark, scratch_path(spark, "t"))
    ip, outcome = ingest(spark, mapping, path, store, **kw)
    rejects = sorted((r["collection"], r["schema_identifier"] or "", r["reason"], r["text"], os.path.basename(r["file"]))
                     for r in ip.rejects().collect())
    return store, rejects, {(r["collection"], r["status"]): r["n"] for r in outcome.collect()}


JSON = '{"id":"1","x":1,"kind":"a"}\n{"id":"2","x":\n{"id":"3","x":3,"kind":"a"}\n\n{"x":9,"kind":"b"}\n{"x":9,"kind":"b"}\n{"id":"2","x":\n'


@pytest.mark.parametrize("staged", [True, False])
@pytest.mark.parametrize("data", [BINS, MORE], ids=["one", "three"])
def test_every_json_line_is_a_document_or_a_reject(spark, local_dir, staged, data):
    store, rejects, outcome = _import(spark, "json", _write(local_dir, "b.json", JSON), data, stage_source=staged)
    assert sorted(r["schema_identifier"] for r in store.scan("Bins").collect()) == ["1", "3"]
    own = [r for r in rejects if r[0] in (SOURCE, "Bins")]
    assert [r[2:] for r in own if r[0] == SOURCE] == [(MALFORMED, '{"id":"2","x":', "b.json")] * 2
    assert [r[2] for r in own if r[0] == "Bins"] == ["NO_KEY"] * 2
    assert all('"x":9' in r[3] for r in own if r[0] == "Bins")  # equal records count each time
    assert outcome["Bins", "CREATED"] == 2 and outcome["Bins", "REJECTED"] == 2 and outcome[SOURCE, "REJECTED"] == 2


@pytest.mark.parametrize("staged", [True, False])
def test_csv_lines_of_a_wrong_shape_are_rejected_and_do_not_spoil_types(spark, local_dir, staged):
    path = _write(local_dir, "b.csv", 'id;x;kind\n1;1.5;a\n"4;8\n2;2;a;surplus\n3\n5;3;b\n;7;c\nz;zz;zz;zz\n')
    store, rejects, outcome = _import(spark, "csv", path, stage_source=staged)
    assert {r["schema_identifier"]: r["x"] for r in store.scan("Bins").collect()} == {"1": 1.5, "5": 3.0}
    assert store.scan("Bins").schema["x"].dataType.simpleString() == "double"
    assert [r[3] for r in rejects if r[2] == MALFORMED] == ['"4;8', "2;2;a;surplus", "3", "z;zz;zz;zz"]
    assert outcome == {("Bins", "CREATED"): 2, ("Bins", "REJECTED"): 1, (SOURCE, "REJECTED"): 4}


def test_only_broken_lines_and_no_lines(spark, local_dir):
    _, rejects, outcome = _import(spark, "json", _write(local_dir, "b.json", "{\n[1\n"), {"Bins": [{"a": "collection", "schema_identifier": "dshs#mapping_1"}]})
    assert [r[3] for r in rejects] == ["[1", "{"] and outcome == {(SOURCE, "REJECTED"): 2}
    _, rejects, outcome = _import(spark, "csv", _write(local_dir, "b.csv", "id;x;kind\n"))
    assert rejects == [] and outcome == {}


def test_a_given_schema_rejects_what_does_not_fit(spark, local_dir):
    path = _write(local_dir, "b.json", '{"id":"1","x":1}\n{"id":"2","x":"many"}\n')
    store, rejects, _ = _import(spark, "json", path, schema="id string, x int")
    assert [r[3] for r in rejects] == ['{"id":"2","x":"many"}'] and store.scan("Bins").count() == 1


def test_element_rejects_hold_the_element(spark, local_dir):
    path = _write(local_dir, "b.json", '{"box":"p","parts":[{"id":"1"},{"w":2},{"w":2}]}\n')
    data = {"Parts": [{"a": "collection", "schema_identifier": "parts/id", "w": "parts/w"}]}
    _, rejects, outcome = _import(spark, "json", path, data)
    assert [r[3] for r in rejects] == ['{"w":2}'] * 2 and outcome["Parts", "REJECTED"] == 2


XML = """<Shelf>
<Box code="07" tall="1.5" n="10" on="true" odd="x"><Lid w="1"/><Lid w="2.25"/></Box>
<Box code="11" tall="2" n="9007199254740993" on="false" odd="3"><Lid w="3"/></Box>
<Box code="12" n="" ok="007"><Lid w="-4e2"/></Box>
</Shelf>"""
BOXES = {"Boxes": [{"a": "collection", "schema_identifier": "_code", "tall": "_tall", "n": "_n", "on": "_on", "odd": "_odd", "ok": "_ok",
                    "lids": {"a": "nested_array", "a_id": "Lid/_w"}}]}


def test_xml_leaves_take_the_type_of_their_values(spark, local_dir):
    path = _write(local_dir, "s.xml", XML)
    store, rejects, _ = _import(spark, "xml", path, BOXES, spec={"rowTag": "Box"})
    docs = {r["schema_identifier"]: r for r in store.scan("Boxes").collect()}
    assert set(docs) == {"07", "11", "12"} and rejects == []  # keys stay text
    kinds = {f.name: f.dataType.simpleString() for f in store.scan("Boxes").schema}
    assert {k: kinds[k] for k in ("tall", "n", "on", "odd", "ok", "lids")} == {
        "tall": "double", "n": "bigint", "on": "boolean", "odd": "string", "ok": "string", "lids": "array<array<double>>"}
    assert docs["11"]["n"] == 9007199254740993 and docs["12"]["n"] is None and docs["12"]["ok"] == "007"
    assert docs["07"]["lids"] == [[1.0], [2.25]] and docs["12"]["lids"] == [[-400.0]]


def test_declared_types_come_first_and_unfit_records_are_rejected(spark, local_dir):
    path = _write(local_dir, "s.xml", XML)
    store, rejects, _ = _import(spark, "xml", path, BOXES, spec={"rowTag": "Box", "types": {"_n": "string", "_odd": "long"}})
    assert store.scan("Boxes").schema["n"].dataType.simpleString() == "string"
    assert [r["schema_identifier"] for r in store.scan("Boxes").orderBy("schema_identifier").collect()] == ["11", "12"]
    assert [(r[0], r[2]) for r in rejects] == [(SOURCE, "BAD_VALUE")] and '"_code":"07"' in rejects[0][3]
    with pytest.raises(ValueError, match="no such leaves"):
        _import(spark, "xml", path, BOXES, spec={"rowTag": "Box", "types": {"_none": "long"}})
    with pytest.raises(ValueError, match="unknown leaf types"):
        parse_mapping({"file": {"format": "json", "types": {"x": "money"}}, "data": {}})


def test_order_of_formats_does_not_decide_types(spark, local_dir):
    xml = _write(local_dir, "s.xml", "<S><Box code='1' x='10'/><Box code='2' x='9'/></S>")
    js = _write(local_dir, "s.json", '{"id":"3","x":10.5}\n{"id":"4","x":100}\n')
    boxes = {"Bins": [{"a": "collection", "schema_identifier": "_code", "x": "_x"}]}
    seen = []
    for first in ("xml", "json"):
        store = CollectionStore(spark, scratch_path(spark, "t"))
        for fmt in ("xml", "json") if first == "xml" else ("json", "xml"):
            _import(spark, fmt, xml if fmt == "xml" else js, boxes if fmt == "xml" else BINS, store, {"rowTag": "Box"})
        seen.append((store.scan("Bins").schema["x"].dataType.simpleString(),
                     {r["schema_identifier"]: r["x"] for r in store.scan("Bins").collect()}))
    assert seen[0] == seen[1] == ("double", {"1": 10.0, "2": 9.0, "3": 10.5, "4": 100.0})


def test_leaf_types_of_mixed_numbers(spark):
    rows = [("1", "0.5", "9007199254740993", [("1", ["2"])]), ("2", "7", "0.5", [(None, ["x"]), ("-3", [])]), ("", None, "1", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d array<struct<e:string,f:array<string>>>")
    assert text_leaves(df.schema) == ["a", "b", "c", "d.e", "d.f"]
    got = {k: v.simpleString() for k, v in leaf_types(df, text_leaves(df.schema)).items()}
    assert got == {"a": "bigint", "b": "double", "d.e": "bigint"}
    assert leaf_types(df.limit(0), ["a"]) == {} and leaf_types(df, []) == {}


def test_rejected_counts_and_a_reader_that_keeps_broken_text(spark, local_dir):
    path = _write(local_dir, "b.json", JSON)
    mapping = {"name": "bins", "file": {"format": "json", "timestamp_format": "ms"}, "data": BINS}
    ip = plan_import(spark, mapping, path, CollectionStore(spark, scratch_path(spark, "t")))
    assert {(r["collection"], r["reason"]): r["n"] for r in ip.rejected_counts().collect()} == {
        (SOURCE, MALFORMED): 2, ("Bins", "NO_KEY"): 2}
    assert read_source(spark, {"format": "json"}, path).filter(F.col("id").isNotNull()).count() == 2

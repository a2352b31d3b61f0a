import pytest

from trackmodel.functions.columns import parse_interval
from trackmodel.functions.pointers import parse_pointer, urlify
from trackmodel.plans.mapping import parse_mapping

LOG_MAPPING = {
    "name": "greenhouse",
    "file": {"format": "csv", "delimiter": ";", "header": "True", "timestamp_format": "ms"},
    "data": {
        "Houses": [{"a": "collection", "schema_identifier": "house", "site": "dshs#mapping_north"}],
        "Probes": [{"a": "collection", "schema_identifier": "probe", "bed": "bed"}],
        "Logs": [{
            "a": "collection", "schema_identifier": "house",
            "readings": {"a": "nested_collection", "n_id": "stamp", "unit": "dshs#mapping_celsius",
                         "values": {"a": "nested_array", "a_id": "probe", "temp": "temp", "additional_fields": ["humid %"]}},
            "partition": {"interval": "5m", "ts_field": "stamp"}}],
    },
}


def test_urlify_rule():
    assert urlify("flow in l/min") == "flow_in_lmin"
    assert urlify("Place.Inner._lat") == "PlaceInner_lat"
    assert urlify("Desk/Loan/_days") == "DeskLoan_days"
    assert urlify("humid %") == "humid_"


def test_pointer_forms():
    p = parse_pointer("flow in l/min", ["flow in l/min"])
    assert p.verbatim and p.explode == ()
    p = parse_pointer("a.b.c")
    assert p.explode == () and p.steps == ("a", "b", "c")
    p = parse_pointer("visits/tech.tools/tool")
    assert p.explode == ("visits", "tech.tools") and p.steps == ("tool",)
    p = parse_pointer("visits/log/[5]")
    assert p.explode == ("visits", "log") and p.steps == (5,)
    p = parse_pointer("dshs#mapping_1")
    assert p.is_literal and p.literal == "1"


def test_pointer_errors():
    with pytest.raises(ValueError):
        parse_pointer("a//b")
    with pytest.raises(ValueError):
        parse_pointer("dshs#input")
    with pytest.raises(ValueError):
        parse_pointer("a/[1]/b")


def test_interval_units():
    assert parse_interval("5m") == (5, "m", 300000)
    assert parse_interval("6h")[2] == 6 * 3600 * 1000
    with pytest.raises(ValueError):  # Q19: unknown unit fails at plan time
        parse_interval("5d")
    with pytest.raises(ValueError):
        parse_interval("m5")


def test_mapping_parse_and_older_shape():
    m = parse_mapping(LOG_MAPPING)
    assert set(m.collections) == {"Houses", "Probes", "Logs"}
    logs = m.collections["Logs"][0]
    assert logs.partition.width_ms == 300000
    assert logs.nested.array.name == "values"
    assert [a.name for a in logs.nested.array.members] == ["a_id", "temp", "humid_"]
    # Q15: a definition dict instead of a list is accepted
    older = {"name": "o", "file": {"format": "csv"}, "data": {"Teams": {"a": "collection", "schema_identifier": "x"}}}
    assert len(parse_mapping(older).collections["Teams"]) == 1


def test_missing_inputs_reported_together():
    m = {"name": "i", "file": {"format": "csv"},
         "data": {"source_name": {"a": "feature", "value": "dshs#input"},
                  "Teams": [{"a": "collection", "schema_identifier": "dshs#input", "name": "dshs#input"}]}}
    with pytest.raises(ValueError) as e:  # Q13: fail fast, list every missing answer
        parse_mapping(m)
    assert "source_name" in str(e.value) and "Teams#schema_identifier" in str(e.value) and "Teams#name" in str(e.value)
    ok = parse_mapping(m, inputs={"source_name": "s", "Teams#schema_identifier": "T", "name": "N"})
    assert ok.features == {"source_name": "s"}
    assert [a.pointer for a in ok.collections["Teams"][0].attrs] == ["dshs#mapping_T", "dshs#mapping_N"]


def test_bad_mapping_shapes():
    with pytest.raises(ValueError):
        parse_mapping({"name": "x", "file": {"format": "avro"}, "data": {}})
    with pytest.raises(ValueError):
        parse_mapping({"name": "x", "file": {"format": "csv"}, "data": {"T": [{"a": "collection", "name": "n"}]}})
    with pytest.raises(ValueError):
        parse_mapping({"name": "x", "file": {"format": "xml"}, "data": {}})

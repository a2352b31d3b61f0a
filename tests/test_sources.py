import json
import os

from pyspark.sql import functions as F

from trackmodel.operators.unnest import unnest
from trackmodel.plans.ingest import extract_documents
from trackmodel.plans.mapping import parse_mapping
from trackmodel.sources.files import read_source
from trackmodel.sources.schema import describe_schema


TICKET_MAPPING = {
    "name": "repairs",
    "file": {"format": "json", "timestamp_format": "ms"},
    "data": {
        "Tickets": [{"a": "collection", "schema_identifier": "ticket", "opened": "opened"}],
        "Techs": [{"a": "collection", "schema_identifier": "visits/tech.id"},
                  {"a": "collection", "schema_identifier": "visits/helper.id"}],
        "Tools": [{"a": "collection", "schema_identifier": "visits/tech.tools/tool", "owner": "visits/tech.id"}],
        "Journals": [{
            "a": "collection", "schema_identifier": "ticket",
            "entries": {"a": "nested_collection", "n_id": "visits/log/[0]", "state": "visits/log/[1]",
                        "path": "visits/log/[2]"},
            "partition": {"interval": "10m", "ts_field": "visits/log/[0]"}}],
    },
}


def _write_tickets(local_dir):
    t0 = 1650000000000
    visits = [{"no": v, "tech": {"id": 7 + v % 2, "tools": [{"tool": 70 + v % 3}, {"tool": 80}]}, "helper": {"id": 9},
               "log": [[t0 + 90_000 * v + 1000 * k, "open" if k else None, [[1.5, v], [2, 3]]] for k in range(3)]}
              for v in range(10)]
    visits.append({"no": 10, "tech": {"id": 7, "tools": []}, "helper": {"id": 9}, "log": []})
    path = os.path.join(local_dir, "tickets.json")
    with open(path, "w") as f:
        f.write(json.dumps({"ticket": "t1", "opened": t0, "visits": visits}) + "\n")
    return path


def test_deep_json_import(spark, local_dir):
    m = parse_mapping(TICKET_MAPPING)
    src = read_source(spark, m.file, _write_tickets(local_dir))
    # mixed log entries infer as array<array<string>>
    assert src.schema["visits"].dataType.elementType["log"].dataType.simpleString() == "array<array<string>>"
    docs, _ = extract_documents(src, m, tag=False)
    # two definitions (tech and helper) of one collection: a bag union
    assert sorted(r[0] for r in docs["Techs"].select("schema_identifier").collect()) == ["7", "8", "9"]
    tools = sorted((r["schema_identifier"], r["owner"]) for r in docs["Tools"].collect())
    assert tools == sorted({(str(t), 7 + v % 2) for v in range(10) for t in (70 + v % 3, 80)})
    assert docs["Tickets"].collect()[0]["opened"] == 1650000000000
    journals = {r["schema_identifier"]: r for r in docs["Journals"].collect()}
    # ten visits 90 s apart: 812 s, cut at 600 s
    assert {k: len(r["entries"]) for k, r in journals.items()} == {"t1__10m_1": 21, "t1__10m_2": 9}
    # the third member arrived as JSON text; it parses back into numbers
    from trackmodel.functions.columns import json_array
    first = docs["Journals"].orderBy("schema_identifier").select(F.explode("entries").alias("m")) \
        .select(json_array(F.col("m.path")).alias("p")).first()["p"]
    assert first == [[1.5, 0.0], [2.0, 3.0]]


VISITS = {
    "name": "visits", "file": {"format": "json", "variant": "True", "timestamp_format": "ms", "types": {
        "visits.log.[0]": "long", "visits.log.[2].[0].[0]": "double", "visits.log.[2]": "array<array<double>>"}},
    "data": {
        "Journals": [{
            "a": "collection", "schema_identifier": "ticket",
            "entries": {"a": "nested_collection", "n_id": "visits/log/[0]", "state": "visits/log/[1]",
                        "path": "visits/log/[2]", "first": "visits/log/[2].[0].[0]", "gone": "visits/log/[9]"},
            "partition": {"interval": "10m", "ts_field": "visits/log/[0]"}}],
        "Techs": [{"a": "collection", "schema_identifier": "visits/tech.id"}],
    },
}


def test_mixed_arrays_keep_their_types_as_variant(spark, local_dir, tmp):
    from trackmodel.plans.ingest import ingest
    from trackmodel.sources.store import CollectionStore

    path = _write_tickets(local_dir)
    with open(path, "a") as f:
        f.write('{"ticket":"t2","visits":[{"tech":{"id":5},"log":[["late","open",null]]}]}\n')  # no number
        f.write('{"ticket":"t3","visits":[{"te\n\n7\n{"ticket":"t4","visits":"none"}\n{"visits":[{"log":[[1650000000000,null,[]]]}]}\n')
    store = CollectionStore(spark, tmp)
    ip, outcome = ingest(spark, VISITS, path, store)
    logs = {r["schema_identifier"]: r["entries"] for r in store.scan("Journals").collect()}
    assert {k: len(v) for k, v in logs.items()} == {"t1__10m_1": 21, "t1__10m_2": 9}
    kind = store.scan("Journals").schema["entries"].dataType.elementType
    assert {f.name: f.dataType.simpleString() for f in kind} == {
        "n_id": "bigint", "state": "string", "path": "array<array<double>>", "first": "double", "gone": "string"}
    one = logs["t1__10m_1"][0]
    assert (one["n_id"], one["state"], one["path"], one["first"], one["gone"]) == (1650000000000, None, [[1.5, 0.0], [2.0, 3.0]], 1.5, None)
    assert logs["t1__10m_1"][1]["state"] == "open"
    assert sorted(r[0] for r in store.scan("Techs").select("schema_identifier").collect()) == ["7", "8"]
    left = sorted((r["collection"], r["reason"], r["text"][:14]) for r in ip.rejects().collect())
    assert [x[:2] for x in left] == [("(source)", "BAD_VALUE"), *[("(source)", "MALFORMED")] * 3, ("Journals", "NO_KEY"), ("Techs", "NO_KEY")]
    assert sorted(x[2] for x in left[1:4]) == ["7", '{"ticket":"t3"', '{"ticket":"t4"']


def test_shared_prefix_explodes_once(spark, local_dir):
    src = read_source(spark, {"format": "json"}, _write_tickets(local_dir))
    u, alias = unnest(src, [("visits",), ("visits", "tech.tools"), ("visits",)])
    plan = u._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2
    assert set(alias) == {("visits",), ("visits", "tech.tools")}


METERS = """<Grid>
<Meter serial="M1"><Read w="9"/><Read w="10"/>
 <Phase id="2"><Burst from="2021/03/01 09:00" peak="2.5"/><Burst from="2021/03/01 09:40" peak="4"/></Phase>
 <Phase id="1"><Burst from="2021/03/01 10:10" peak="1"/></Phase><Site><Room>cellar</Room></Site></Meter>
</Grid>"""

METER_MAPPING = {
    "name": "meters",
    "data": {
        "Hours": [{
            "partition": {"interval": "1h", "ts_field": "Phase/Burst/_from"},
            "peaks": {"a": "nested_array", "a_id": "Phase/Burst/_from", "peak": "Phase/Burst/_peak"},
            "a": "collection", "schema_identifier": "Phase/_id", "meter": "_serial"}],
        "Reads": [{"a": "collection", "schema_identifier": "_serial", "reads": {"a": "nested_collection", "n_id": "Read/_w"}}],
        "Rooms": {"a": "collection", "schema_identifier": "Site.Room"},
    },
    "file": {"rowTag": "Meter", "format": "xml", "timestamp_format": "yyyy/MM/dd HH:mm"},
}


def test_xml_import_as_text(spark, local_dir):
    path = os.path.join(local_dir, "meters.xml")
    with open(path, "w") as f:
        f.write(METERS)
    m = parse_mapping(METER_MAPPING)
    docs, _ = extract_documents(read_source(spark, m.file, path), m, tag=False)
    assert docs["Rooms"].first()["schema_identifier"] == "cellar"
    # read without types, ids and values are text: "10" sorts before "9"
    assert [x["n_id"] for x in docs["Reads"].first()["reads"]] == ["10", "9"]
    hours = {r["schema_identifier"]: r for r in docs["Hours"].collect()}
    assert set(hours) == {"2__1h_1", "1__1h_2"}
    assert hours["2__1h_1"]["peaks"] == [["2021/03/01 09:00", "2.5"], ["2021/03/01 09:40", "4"]]
    assert hours["1__1h_2"]["peaks_cols"] == ["a_id", "peak"] and hours["1__1h_2"]["meter"] == "M1"


def test_patterns_keep_milliseconds_and_zones(spark):
    from trackmodel.functions.columns import to_epoch_ms

    t = spark.createDataFrame([("2021-03-01T09:00:00.500+01:00",), ("2021-03-01",)], "t string")
    got = [r[0] for r in t.select(to_epoch_ms(F.col("t"), t.schema["t"].dataType, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).collect()]
    assert got == [1614585600500, None]


def test_xml_single_child_is_struct(spark, local_dir):
    # A lone repeated child is inferred as a struct; unnesting takes it as one element
    path = os.path.join(local_dir, "one.xml")
    with open(path, "w") as f:
        f.write('<Library><Branch><Desk name="d"><Loan id="1" book="K"/></Desk></Branch><Branch><Desk name="e"/></Branch></Library>')
    src = read_source(spark, {"format": "xml", "rowTag": "Branch"}, path)
    u, a = unnest(src, [("Desk", "Loan")])
    r = u.select(F.col(a[("Desk", "Loan")])._id.alias("n"), F.col(a[("Desk",)])._name.alias("p")).collect()
    assert [(x.n, x.p) for x in r] == [("1", "d")]  # the childless desk drops out, as with an empty array
    kept, b = unnest(src, [("Desk", "Loan")], outer=True)
    assert kept.count() == 2


def test_schema_counts_below_null_arrays(spark):
    df = spark.createDataFrame([([([1, 2],), (None,), ([3],)],)], "a array<struct<b:array<int>>>")
    assert {r["path"]: r["non_null"] for r in describe_schema(df).collect()} == {"a": 1, "a.b": 2, "a.b[]": 3}


def test_describe_schema_all_types(spark):
    df = spark.createDataFrame(
        [(1, [1, 2], {"k": 1}, [[1.0, None]], ("a", [("x", 2)])), (None, None, None, [], None)],
        "id int, prims array<int>, m map<string,int>, aa array<array<double>>, "
        "s struct<name:string, items:array<struct<c:string,n:int>>>")
    rows = {r["path"]: r for r in describe_schema(df).collect()}
    assert rows["id"]["non_null"] == 1 and rows["id"]["type"] == "integer"
    assert rows["prims[]"]["name"] == "_element" and rows["prims[]"]["non_null"] == 2  # Q16: primitives
    assert rows["m"]["type"] == "map"
    assert rows["aa[]"]["type"] == "array" and rows["aa[][]"]["non_null"] == 1
    assert rows["s.items.n"]["non_null"] == 1 and rows["s.items.n"]["level"] == 2
    assert [r["ord"] for r in describe_schema(df).orderBy("ord").collect()] == list(range(len(rows)))


def test_scale_conf_sizes_partitions():
    from trackmodel.session import scale_conf
    c = scale_conf(100 * 1024 ** 4)
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "200"

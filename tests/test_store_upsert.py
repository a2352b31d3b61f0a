import pytest
from pyspark.sql import functions as F

from tests.conftest import LOG_MAPPING, write_log
from trackmodel.operators import upsert
from trackmodel.plans.ingest import apply_import, ingest, plan_import, stage_plan
from trackmodel.session import scratch_path
from trackmodel.sources.store import CollectionStore, VersionConflict

SCHEMA = "schema_identifier string, name string, score int, info struct<a:int,b:string>"


def _store(spark, tmp, rows):
    store = CollectionStore(spark, tmp)
    store.initialize("Teams", spark.createDataFrame(rows, SCHEMA))
    return store


def test_store_versions_scan_page_lookup(spark, tmp):
    store = _store(spark, tmp, [(str(i), f"t{i}", i, (i, "x")) for i in range(30)])
    assert store.versions("Teams") == [1]
    assert store.scan("Nope").count() == 0
    page = [r[0] for r in store.page("Teams", 2, 10).select("schema_identifier").collect()]
    assert page == sorted(str(i) for i in range(30))[10:20]
    after = [r[0] for r in store.page_after("Teams", page[-1], 10).select("schema_identifier").collect()]
    assert after == sorted(str(i) for i in range(30))[20:30]
    keys = spark.createDataFrame([("3",), ("7",), ("99",)], "k string")
    assert sorted(r[0] for r in store.lookup("Teams", keys).select("schema_identifier").collect()) == ["3", "7"]
    ids = [r[0] for r in store.scan("Teams").filter("schema_identifier = '3'").select("_id").collect()]
    assert store.lookup("Teams", ids, by="_id").count() == 1


def test_merge_incoming_wins_null_is_absent(spark, tmp):
    store = _store(spark, tmp, [("1", "old", 1, (1, "keep"))])
    inc = spark.createDataFrame([("1", None, 5, (None, "new"), "extra"), ("2", "n2", 2, None, None)],
                                SCHEMA + ", more string")
    plan = {r["schema_identifier"]: r for r in upsert.plan_upsert(inc, store.scan("Teams"), "Teams").collect()}
    assert plan["1"]["op"] == "UPDATE" and plan["2"]["op"] == "CREATE"
    assert plan["1"]["name"] == "old" and plan["1"]["score"] == 5  # null = absent; incoming wins
    assert plan["1"]["info"]["a"] == 1 and plan["1"]["info"]["b"] == "new"  # structs merge per field
    assert plan["1"]["more"] == "extra"


def test_apply_is_idempotent_and_detects_conflicts(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, None), ("2", "b", 2, None), ("3", "c", 3, None)])
    inc = spark.createDataFrame([("1", "A", 1, None), ("2", "b", 2, None), ("4", "d", 4, None)], SCHEMA)
    plan = upsert.plan_upsert(inc, store.scan("Teams"), "Teams")
    v, out = upsert.apply_plan(plan, store.scan("Teams"), "Teams")
    store.write_version("Teams", v)
    st = {r[0]: r[1] for r in out.select("schema_identifier", "status").collect()}
    assert st == {"1": "UPDATED", "2": "UPDATED", "4": "CREATED"}
    after = {r["schema_identifier"]: r for r in store.scan("Teams").collect()}
    before = {r["schema_identifier"]: r for r in store.scan("Teams", version=1).collect()}
    assert after["1"]["name"] == "A" and after["1"]["_etag"] != before["1"]["_etag"]
    assert after["2"]["_etag"] == before["2"]["_etag"]  # unchanged content keeps its etag
    assert after["3"]["_updated"] == before["3"]["_updated"]
    # second run of the same batch: no create, and no etag moves
    plan2 = upsert.plan_upsert(inc, store.scan("Teams"), "Teams")
    assert plan2.filter("op = 'CREATE'").count() == 0
    v2, _ = upsert.apply_plan(plan2, store.scan("Teams"), "Teams")
    assert sorted(r["_etag"] for r in v2.collect()) == sorted(r["_etag"] for r in after.values())
    # a concurrent change between plan and apply turns the planned update into a conflict
    stale = upsert.plan_upsert(spark.createDataFrame([("3", "C", 3, None), ("5", "e", 5, None)], SCHEMA),
                               store.scan("Teams"), "Teams")
    other = upsert.plan_upsert(spark.createDataFrame([("3", "X", 9, None), ("5", "y", 5, None)], SCHEMA),
                               store.scan("Teams"), "Teams")
    v3, _ = upsert.apply_plan(other, store.scan("Teams"), "Teams")
    store.write_version("Teams", v3)
    v4, out4 = upsert.apply_plan(stale, store.scan("Teams"), "Teams")
    st4 = {r[0]: r[1] for r in out4.select("schema_identifier", "status").collect()}
    assert st4 == {"3": "CONFLICT", "5": "CONFLICT"}
    assert {r["schema_identifier"]: r["name"] for r in v4.collect()}["3"] == "X"


def test_duplicate_keys_apply_once(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, None)])
    inc = spark.createDataFrame([("7", "z", 1, None, 1), ("7", "y", 1, None, 0), ("7", "y", 1, None, 0),
                                 ("1", "b", 1, None, 0)], SCHEMA + ", __def int")
    assert upsert.batch_duplicates(inc).collect()[0]["n"] == 3
    plan = upsert.plan_upsert(inc, store.scan("Teams"), "Teams")
    v, out = upsert.apply_plan(plan, store.scan("Teams"), "Teams")
    rows = {r["schema_identifier"]: r for r in v.collect()}
    assert rows["7"]["name"] == "y"  # first definition wins
    st = sorted(tuple(r) for r in out.select("schema_identifier", "status", "n").collect())
    assert st == [("1", "UPDATED", 1), ("7", "CREATED", 1), ("7", "DUPLICATE", 2)]


def test_replace_and_delete(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, (1, "x")), ("2", "b", 2, None)])
    new = spark.createDataFrame([("1", "A", None, None), ("3", "c", 3, None), (None, "k", 0, None)], SCHEMA)
    v, st = upsert.replace_by_key(store.scan("Teams"), new, "Teams", overwrite=False)
    assert {r["schema_identifier"]: r["status"] for r in st.collect()} == {"1": "EXISTS", "3": "CREATED", None: "NO_KEY"}
    v, st = upsert.replace_by_key(store.scan("Teams"), new, "Teams", overwrite=True)
    rows = {r["schema_identifier"]: r for r in v.collect()}
    assert rows["1"]["name"] == "A" and rows["1"]["info"] is None and rows["1"]["score"] is None  # whole row
    assert set(rows) == {"1", "2", "3"}
    left = upsert.delete_by_key(store.scan("Teams"), spark.createDataFrame([("2",)], "k string"))
    assert [r[0] for r in left.select("schema_identifier").collect()] == ["1"]


def test_end_to_end_ingest_twice(spark, tmp, log_file):
    store = CollectionStore(spark, tmp)
    ip, outcome = ingest(spark, LOG_MAPPING, log_file, store)
    counts = {(r["collection"], r["op"]): r["n"] for r in ip.counts().collect()}
    assert counts == {("Houses", "CREATE"): 2, ("Probes", "CREATE"): 6, ("Logs", "CREATE"): 6}
    assert {r["status"] for r in outcome.collect()} == {"CREATED"}
    assert ip.rejected_counts().count() == 0
    etags = {r["schema_identifier"]: r["_etag"] for r in store.scan("Logs").collect()}
    ip2 = plan_import(spark, LOG_MAPPING, log_file, store)
    assert {r["op"] for r in ip2.counts().collect()} == {"UPDATE"}
    apply_import(spark, ip2, store)
    assert {r["schema_identifier"]: r["_etag"] for r in store.scan("Logs").collect()} == etags
    assert store.versions("Logs") == [1, 2]
    assert store.scan("Probes").filter(F.col("_id").isNull()).count() == 0
    assert store.vacuum("Logs", keep=1) == [1] and store.versions("Logs") == [2]
    store.drop("Logs")
    assert store.scan("Logs").count() == 0


def test_outcome_counts_rejects(spark, tmp, local_dir):
    path = write_log(local_dir, "bad.csv", ["1000|H0|B0|1|1.5|40|", "soon|H0|B0|2|1.5|40|", "||B0||1.5|40|"])
    _, outcome = ingest(spark, LOG_MAPPING, path, CollectionStore(spark, tmp))
    got = {(r["collection"], r["status"]): r["n"] for r in outcome.collect()}
    assert got == {("Houses", "CREATED"): 1, ("Houses", "REJECTED"): 1, ("Probes", "CREATED"): 2, ("Probes", "REJECTED"): 1,
                   ("Logs", "CREATED"): 1, ("Logs", "REJECTED"): 2}


def test_values_that_do_not_fit_are_rejected(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, None), ("2", "b", 2, None)])
    inc = spark.createDataFrame([("1", "a", "high"), ("2", "B", "7")], "schema_identifier string, name string, score string")
    v, out = upsert.apply_plan(upsert.plan_upsert(inc, store.scan("Teams"), "Teams"), store.scan("Teams"), "Teams")
    assert v.schema["score"].dataType.simpleString() == "int"  # one odd batch does not retype the collection
    assert {r["schema_identifier"]: (r["name"], r["score"]) for r in v.collect()} == {"1": ("a", 1), "2": ("B", 7)}
    assert {r["schema_identifier"]: r["status"] for r in out.collect()} == {"1": "REJECTED", "2": "UPDATED"}
    v, st = upsert.replace_by_key(store.scan("Teams"), inc, "Teams", overwrite=True)
    assert {r["schema_identifier"]: r["status"] for r in st.collect()} == {"1": "REJECTED", "2": "REPLACED"}
    assert {r["schema_identifier"]: r["score"] for r in v.collect()} == {"1": 1, "2": 7}


def test_nested_columns_keep_their_types(spark, tmp):
    store = CollectionStore(spark, tmp)
    docs = spark.createDataFrame([("1", ["a"], [1.5], (1,), [(1, [2])]), ("2", ["b"], None, None, None)],
                                 "schema_identifier string, s array<string>, d array<double>, info struct<n:int>, "
                                 "m array<struct<i:int,t:array<int>>>")
    store.initialize("C", docs)
    before = {r["schema_identifier"]: r["_etag"] for r in store.scan("C").collect()}
    for same in (docs, docs.select([F.col(c) for c in docs.columns[::-1]])):
        v, _ = upsert.apply_plan(upsert.plan_upsert(same, store.scan("C"), "C"), store.scan("C"), "C")
        assert {r["schema_identifier"]: r["_etag"] for r in v.collect()} == before
    wider = spark.createDataFrame([("1", (5, "k"), [(3, [4.5], "z")]), ("3", None, None)],
                                  "schema_identifier string, info struct<n:long,k:string>, m array<struct<i:int,t:array<double>,u:string>>")
    v, out = upsert.apply_plan(upsert.plan_upsert(wider, store.scan("C"), "C"), store.scan("C"), "C")
    assert v.schema["info"].dataType.simpleString() == "struct<n:bigint,k:string>"
    assert v.schema["m"].dataType.simpleString() == "array<struct<i:int,t:array<double>,u:string>>"
    rows = {r["schema_identifier"]: r for r in v.collect()}
    assert tuple(rows["1"]["info"]) == (5, "k") and rows["1"]["s"] == ["a"] and tuple(rows["1"]["m"][0]) == (3, [4.5], "z")
    assert rows["2"]["s"] == ["b"] and rows["2"]["_etag"] == before["2"] and set(rows) == {"1", "2", "3"}
    v, st = upsert.replace_by_key(store.scan("C"), docs, "C", overwrite=True)
    assert {r["schema_identifier"]: r["_etag"] for r in v.collect()} == before


def test_second_writer_is_refused_and_applies_again(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, None), ("2", "b", 2, None)])
    base = store.current_version("Teams")
    first = spark.createDataFrame([("1", "A", 1, None)], SCHEMA)
    second = spark.createDataFrame([("2", "B", 2, None)], SCHEMA)
    made = [upsert.apply_plan(upsert.plan_upsert(d, store.scan("Teams"), "Teams"), store.scan("Teams"), "Teams")[0]
            for d in (first, second)]
    assert store.write_version("Teams", made[0], base) == base + 1
    with pytest.raises(VersionConflict):
        store.write_version("Teams", made[1], base)
    again, _ = upsert.apply_plan(upsert.plan_upsert(second, store.scan("Teams"), "Teams"), store.scan("Teams"), "Teams")
    store.write_version("Teams", again, base + 1)
    assert {r["schema_identifier"]: r["name"] for r in store.scan("Teams").collect()} == {"1": "A", "2": "B"}
    assert store.lookup("Teams", ["1", store.scan("Teams").filter("name = 'B'").first()["_id"]]).count() == 2


def test_widening_never_changes_a_stored_value(spark, tmp):
    store = CollectionStore(spark, tmp)
    big = 2 ** 53 + 1
    store.initialize("C", spark.createDataFrame([("1", big, 1, [big]), ("2", 5, 2, [7])],
                                                "schema_identifier string, x long, y long, z array<long>"))
    before = {r["schema_identifier"]: r for r in store.scan("C").collect()}
    inc = spark.createDataFrame([("3", 0.5, 0.5, None), ("4", 8.0, 2.5, [3.0]), ("2", 6.0, None, [0.25])],
                                "schema_identifier string, x double, y double, z array<double>")
    v, out = upsert.apply_plan(upsert.plan_upsert(inc, store.scan("C"), "C"), store.scan("C"), "C")
    assert {r["schema_identifier"]: r["status"] for r in out.collect()} == {"3": "REJECTED", "4": "CREATED", "2": "REJECTED"}
    assert {f.name: f.dataType.simpleString() for f in v.schema}["x"] == "bigint"
    assert {f.name: f.dataType.simpleString() for f in v.schema}["y"] == "double"  # no stored value is lost by it
    rows = {r["schema_identifier"]: r for r in v.collect()}
    assert rows["1"]["x"] == big and rows["1"]["z"] == [big] and rows["4"]["x"] == 8 and rows["4"]["y"] == 2.5
    assert all(rows[k]["_etag"] == before[k]["_etag"] for k in ("1", "2"))
    v, st = upsert.replace_by_key(store.scan("C"), inc, "C", overwrite=True)
    assert {r["schema_identifier"]: r["status"] for r in st.collect()} == {"3": "REJECTED", "4": "CREATED", "2": "REJECTED"}
    # a long that no double has, into doubles; digits that no decimal type has room for; digits of text
    store.initialize("D", spark.createDataFrame([("1", 0.5)], "schema_identifier string, x double"))
    for value, kind, status in ((big, "long", "REJECTED"), (7, "long", "CREATED"), (str(big), "string", "REJECTED"), ("2.5", "string", "CREATED")):
        inc = spark.createDataFrame([("9", value)], f"schema_identifier string, x {kind}")
        v, out = upsert.apply_plan(upsert.plan_upsert(inc, store.scan("D"), "D"), store.scan("D"), "D")
        assert [r["status"] for r in out.collect()] == [status], value
        assert v.schema["x"].dataType.simpleString() == "double"
    from decimal import Decimal

    store.initialize("E", spark.createDataFrame([("1", Decimal(10 ** 29))], "schema_identifier string, x decimal(38,0)"))
    inc = spark.createDataFrame([("2", Decimal("0.0000000001")), ("3", Decimal(4))], "schema_identifier string, x decimal(38,10)")
    v, out = upsert.apply_plan(upsert.plan_upsert(inc, store.scan("E"), "E"), store.scan("E"), "E")
    assert {r["schema_identifier"]: r["status"] for r in out.collect()} == {"2": "REJECTED", "3": "CREATED"}
    assert {r["schema_identifier"]: r["x"] for r in v.collect()} == {"1": Decimal(10 ** 29), "3": Decimal(4)}


def test_types_settle_again_when_a_plan_is_applied(spark, tmp):
    store = CollectionStore(spark, tmp)
    schema = "schema_identifier string, x long"
    store.initialize("C", spark.createDataFrame([("1", 5)], schema))
    inc = spark.createDataFrame([("2", 0.5), ("3", 2.0)], "schema_identifier string, x double")
    plan, seen = upsert.observe_plan(upsert.plan_upsert(inc, store.scan("C"), "C"))
    plan = stage_plan(plan, scratch_path(spark, "p"))
    other = spark.createDataFrame([("7", 2 ** 53 + 1)], schema)
    store.write_version("C", upsert.apply_plan(upsert.plan_upsert(other, store.scan("C"), "C"), store.scan("C"), "C")[0], 1)
    v, outcome = upsert.apply_counted(plan, seen.get, store.scan("C"), "C")
    store.write_version("C", v, 2)
    assert sorted(outcome()) == [("CREATE", "CREATED", 1), ("CREATE", "REJECTED", 1)]
    assert {r["schema_identifier"]: r["x"] for r in store.scan("C").collect()} == {"1": 5, "7": 2 ** 53 + 1, "3": 2}


def test_counts_while_writing_equal_the_joined_outcome(spark, tmp):
    store = _store(spark, tmp, [(str(i), "a", i, None) for i in range(6)])
    inc = spark.createDataFrame([("1", "A", 1, None), ("2", "B", 2, None), ("2", "b", 2, None), ("8", "n", 8, None),
                                 ("9", "m", 9, None), ("9", "l", 9, None)], SCHEMA)
    stale, seen = upsert.observe_plan(upsert.plan_upsert(inc, store.scan("Teams"), "Teams"))
    stale = stage_plan(stale, scratch_path(spark, "p"))
    assert seen.get == {"CREATE": 3, "UPDATE": 3, "REJECT": 0}
    for change in (upsert.delete_by_key(store.scan("Teams"), ["2"]),):
        store.write_version("Teams", change)
    other = spark.createDataFrame([("1", "X", 1, None), ("8", "taken", 8, None)], SCHEMA)
    now = store.scan("Teams")
    store.write_version("Teams", upsert.apply_plan(upsert.plan_upsert(other, now, "Teams"), now, "Teams")[0])
    now = store.scan("Teams")
    joined = upsert.apply_plan(stale, now, "Teams")[1].groupBy("op", "status").agg(F.sum("n")).collect()
    v, outcome = upsert.apply_counted(stale, seen.get, now, "Teams")
    store.write_version("Teams", v)
    assert sorted(outcome()) == sorted(map(tuple, joined))
    assert sorted(outcome()) == [("CREATE", "CONFLICT", 1), ("CREATE", "CREATED", 1), ("CREATE", "DUPLICATE", 1),
                                 ("UPDATE", "CONFLICT", 2), ("UPDATE", "DUPLICATE", 1)]


def test_pages_at_any_depth(spark, tmp, monkeypatch):
    from trackmodel.sources import store as module

    store = _store(spark, tmp, [(str(i), f"t{i}", i, None) for i in range(600)])
    keys = sorted(str(i) for i in range(600))
    page = lambda n: [r[0] for r in store.page("Teams", n, 10).select("schema_identifier").collect()]
    monkeypatch.setattr(module, "MAX_TOP_ROWS", 100)
    assert page(3) == keys[20:30] and page(31) == keys[300:310] and page(60) == keys[590:] and page(61) == []
    tags = {r["schema_identifier"]: r["_etag"] for r in store.scan("Teams").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.order("Teams")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["schema_identifier"]: r["_etag"] for r in store.scan("Teams").collect()} == tags
    assert spark.read.parquet(store.path("Teams", 2) + ".ranks").count() > 1
    for n in (1, 2, 30, 60):
        assert page(n) == keys[10 * (n - 1):10 * n]
        assert len(store.page("Teams", n, 10).inputFiles()) <= 2
    assert page(61) == [] and store.page("None", 5).count() == 0
    assert store.vacuum("Teams", 1) == [1] and page(60) == keys[590:]


def test_a_dead_claim_expires_and_a_slow_writer_loses(spark, tmp):
    store = _store(spark, tmp, [("1", "a", 1, None)])
    docs = store.scan("Teams")
    dead = store.claim("Teams", 1)
    with pytest.raises(VersionConflict):  # a fresh claim is respected
        store.write_version("Teams", docs, 1)
    patient = CollectionStore(spark, tmp, claim_seconds=0)
    assert patient.write_version("Teams", docs.withColumn("name", F.lit("later")), 1) == 2
    # the first writer was only slow: it wrote, but its claim is no longer the last one
    docs.withColumn("name", F.lit("slow")).write.parquet(dead.path)
    with pytest.raises(VersionConflict):
        dead.commit()
    dead.give_up()
    assert store.versions("Teams") == [1, 2] and store.scan("Teams").first()["name"] == "later"
    # taken over, but the first one commits in time: the other is refused and nothing of it counts
    first = store.claim("Teams", 2)
    second = patient.claim("Teams", 2)
    assert second.attempt == first.attempt + 1 and second.path != first.path
    docs.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(second.path)
    second.commit()
    with pytest.raises(VersionConflict):
        first.commit()
    assert store.versions("Teams") == [1, 2, 3] and store.scan("Teams").first()["name"] == "a"
    store.claim("Teams", 3)
    store.release("Teams", 4)
    assert store.write_version("Teams", docs, 3) == 4


def test_first_failure_stops_the_rest(spark):
    from trackmodel.session import together

    assert together(spark, [lambda i=i: spark.range(i + 1).count() for i in range(12)], limit=3) == list(range(1, 13))
    started = []

    def work(i):
        started.append(i)
        if i == 1:
            raise KeyError("one")
        return spark.range(100).count()

    with pytest.raises(KeyError, match="one"):
        together(spark, [lambda i=i: work(i) for i in range(50)], limit=2)
    assert len(started) < 50

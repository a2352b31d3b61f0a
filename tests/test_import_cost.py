"""What an import or an apply must not do again: read its inputs twice, join what cannot meet, try text that is no number."""

import glob
import time

from pyspark.sql import functions as F

from trackmodel.functions.columns import pack_hex, unpack_hex
from trackmodel.functions.pointers import KEY
from trackmodel.operators import upsert
from trackmodel.plans.ingest import ingest
from trackmodel.session import list_dirs, scratch_path
from trackmodel.sources.store import CollectionStore
from trackmodel.sources.typed import leaf_types


def people(spark, rows):
    return spark.createDataFrame(rows, f"{KEY} string, x long")


def store_of(spark, tmp, rows):
    store = CollectionStore(spark, tmp)
    store.initialize("P", people(spark, rows))
    return store


def test_apply_plan_reads_the_plan_once(spark, tmp):
    store = store_of(spark, tmp, [("a", 1), ("b", 2)])
    path = scratch_path(spark, "batch")
    people(spark, [("b", 5), ("c", 6), ("c", 6)]).write.parquet(path)
    stored = store.scan("P")
    plan = upsert.plan_upsert(spark.read.parquet(path), stored, "P")
    version, outcome = upsert.apply_plan(plan, stored, "P")
    for df in (version, outcome):
        assert not [f for f in df.inputFiles() if path in f]
    assert {(r[0], r.x) for r in version.collect()} == {("a", 1), ("b", 5), ("c", 6)}
    assert {(r[1], r.status, r.n) for r in outcome.collect()} == {("b", "UPDATED", 1), ("c", "CREATED", 1), ("c", "DUPLICATE", 1)}


def test_creates_alone_against_their_own_base_need_no_join(spark, tmp):
    store = store_of(spark, tmp, [("a", 1)])
    stored = store.scan("P")
    plan = upsert.plan_upsert(people(spark, [("b", 2), ("b", 3)]), stored, "P")
    path = scratch_path(spark, "plan")
    plan.write.parquet(path)
    plan = spark.read.parquet(path)
    one = plan.filter("x = 2")
    version, outcome = upsert.apply_counted(one, {"CREATE": 1, "UPDATE": 0}, stored, "P", unique=True, same_base=True)
    assert "Join" not in version._jdf.queryExecution().optimizedPlan().toString()
    store.write_version("P", version, 1)
    assert outcome() == [("CREATE", "CREATED", 1)]
    assert {(r[0], r.x) for r in store.scan("P").collect()} == {("a", 1), ("b", 2)}
    # made against an older version: the key has come meanwhile and is a conflict
    version, outcome = upsert.apply_counted(one, {"CREATE": 1}, store.scan("P"), "P", unique=True)
    store.write_version("P", version, 2)
    assert outcome() == [("CREATE", "CONFLICT", 1)]
    # repeated keys are applied once, joined or not
    version, outcome = upsert.apply_counted(plan, {"CREATE": 2, "UPDATE": 0}, stored, "P", same_base=True)
    assert sorted(r[0] for r in version.collect()) == ["a", "b"]


def test_repeated_keys_are_found_without_reading_documents(spark, tmp):
    docs = people(spark, [("a", 1), ("b", 2), ("b", 3), (None, 4), (None, 5)]).withColumn("op", F.lit("CREATE"))
    one, dups = upsert.dedup_plan(docs)
    assert sorted(r[0] for r in one.filter(f"{KEY} IS NOT NULL").collect()) == ["a", "b"]
    assert {tuple(r) for r in dups.collect()} == {("b", "CREATE", 1), (None, "CREATE", 1)}
    once = docs.filter("x < 3")
    same, none = upsert.dedup_plan(once)
    assert same is once and none.isEmpty()
    # nothing left to compute: the duplicates of a batch without any are empty as planned
    assert "Aggregate" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_versions_are_written_compressed(spark, tmp):
    store_of(spark, tmp, [("a", 1)])
    files = glob.glob(f"{tmp.removeprefix('file:')}/P/v*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_types_of_text_that_is_no_number(spark):
    kinds = {"-0": "double", "+1": None, " 1": None, "007": None, "9223372036854775807": "bigint", "9223372036854775808": None,
             "1e999": None, "1.10": "double", "-5": "bigint", "true": "boolean", "x": None, ".5": None, "NaN": None}
    df = spark.createDataFrame([tuple(kinds)], ", ".join(f"c{i} string" for i in range(len(kinds))))
    found = leaf_types(df, df.columns)
    assert [found[c].simpleString() if c in found else None for c in df.columns] == list(kinds.values())
    # casts are tried on text that looks like a number alone; a failed one costs an exception
    from trackmodel.sources.typed import _as_long
    assert "CASE WHEN" in str(_as_long(F.col("v"))).upper()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_an_import_leaves_no_shuffle_files(spark, tmp, local_dir):
    path = f"{local_dir}/a.json"
    with open(path, "w") as f:
        f.writelines(f'{{"id":{i % 40},"at":{i},"v":{i}}}\n' for i in range(400))
    mapping = {"name": "a", "file": {"format": "json", "timestamp_format": "ms"}, "data": {"Ids": [
        {"a": "collection", KEY: "id"}], "Curves": [{"a": "collection", KEY: "id", "points": {
            "a": "nested_collection", "n_id": "at", "values": {"a": "nested_array", "a_id": "at", "v": "v"}}}]}}
    before, store = shuffle_files(spark), CollectionStore(spark, tmp)
    for _ in range(2):
        ip, outcome = ingest(spark, mapping, path, store)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert {(r.collection, r.status, r.n) for r in outcome.collect()} == {("Ids", "UPDATED", 40), ("Curves", "UPDATED", 40)}
    # what was staged to make the plans is gone, the plans are not; the session's setting is as it was
    assert {p.count() for p in ip.plans.values()} == {40}
    assert not [n for n in list_dirs(spark, ip.stage_dir) if n == "__source" or n.endswith("__documents")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def applied(spark, stored, batch, same_base, where):
    """(rows of the version, outcome, its plan) of ``batch`` applied to what ``stored`` holds."""
    path = scratch_path(spark, "plan")
    plan, seen = upsert.observe_plan(upsert.plan_upsert(batch, stored, "P"))
    plan.write.partitionBy("op").parquet(path)
    plan = spark.read.schema(plan.schema).parquet(path)
    store = CollectionStore(spark, where)
    version, outcome = upsert.apply_counted(plan, seen.get, stored, "P", F.lit("2020-01-01").cast("timestamp"), same_base=same_base)
    text = version._jdf.queryExecution().optimizedPlan().toString()
    store.write_version("P", version, 0)
    return sorted(map(str, store.scan("P").collect())), sorted(outcome()), text


def test_updates_against_their_own_base_join_keys_alone(spark, tmp, monkeypatch):
    stored = store_of(spark, f"{tmp}/s", [("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)]).scan("P")
    every = [("a", 1), ("b", 7), ("c", None), ("d", 4)]
    twice = [("a", 3), ("a", 4), ("b", 5), ("z", 8), ("z", 9)]
    # few updates; many, few documents beside them (one without a key); many of both
    for i, (few, rows) in enumerate([(100_000, twice), (2, every[:3]), (0, every[:2])]):
        monkeypatch.setattr(upsert, "MAX_BROADCAST_KEYS", few)
        got = [applied(spark, stored, people(spark, rows), same, f"{tmp}/{i}{same}") for same in (True, False)]
        assert got[0][:2] == got[1][:2], i
    # all documents updated: no join is left
    whole = people(spark, [*every, ("e", 6)])
    named = stored.filter(f"{KEY} IS NOT NULL")
    rows, outcome, text = applied(spark, named, whole, True, f"{tmp}/all")
    assert "Join" not in text
    assert outcome == [("CREATE", "CREATED", 1), ("UPDATE", "UPDATED", 4)]
    assert (rows, outcome) == applied(spark, named, whole, False, f"{tmp}/all-joined")[:2]


def test_repeated_or_untagged_documents_are_told_apart_by_their_tags(spark, tmp):
    twice = store_of(spark, f"{tmp}/s", [("a", 1), ("a", 2), ("b", 3)]).scan("P")
    untagged = store_of(spark, f"{tmp}/u", [("a", 1), ("b", 3)]).scan("P").withColumn("_etag", F.expr("if(x = 1, null, _etag)"))
    for i, stored in enumerate((twice, untagged)):
        got = [applied(spark, stored, people(spark, [("a", 9), ("b", 9)]), same, f"{tmp}/{i}{same}") for same in (True, False)]
        assert got[0][:2] == got[1][:2]


def test_stored_values_that_a_batch_replaces_are_not_read(spark, tmp):
    stored = store_of(spark, f"{tmp}/s", [("a", 1), ("b", 2)]).scan("P")
    batch = people(spark, [("a", 5), ("c", 6)])
    plan = upsert.plan_upsert(batch, stored, "P", filled={KEY, "x"})
    scan = [r for r in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in r]
    assert scan and not any("x:bigint" in r for r in scan)
    assert sorted(map(str, plan.collect())) == sorted(map(str, upsert.plan_upsert(batch, stored, "P").collect()))
    # rebuilt columns and structs keep what the stored side adds
    wide = spark.createDataFrame([("a", (1, None))], f"{KEY} string, s struct<p:int,q:int>")
    CollectionStore(spark, f"{tmp}/w").initialize("W", spark.createDataFrame([("a", (3, 4))], f"{KEY} string, s struct<p:int,q:int>"))
    old = CollectionStore(spark, f"{tmp}/w").scan("W")
    assert tuple(upsert.plan_upsert(wide, old, "W", filled={KEY, "s"}).first().s) == (1, 4)


def test_tags_are_packed_and_unpacked(spark):
    texts = ["", "00ff", "00FF", "0", "abc", "x", "0aé", None, "ab" * 32]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pack_hex(F.col("t")).alias("p"))
    rows = df.select("t", unpack_hex(F.col("p")).alias("u"), F.length("p.hex").alias("n")).collect()
    assert all(r.t == r.u for r in rows) and {r.n for r in rows if r.t == "ab" * 32} == {32}

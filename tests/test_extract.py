import os

from pyspark.sql import functions as F

from tests.conftest import LOG_MAPPING, n_points, write_log
from trackmodel.operators import timeparts
from trackmodel.operators.nest import expand_collection, expand_tuples, to_documents
from trackmodel.plans.extract import extract_definition, split_rejected
from trackmodel.plans.ingest import extract_documents
from trackmodel.plans.mapping import parse_definition, parse_mapping
from trackmodel.sources.files import read_source


def _docs(spark, path, mapping=LOG_MAPPING, **kw):
    m = parse_mapping(mapping)
    src = read_source(spark, m.file, path)
    docs, rejects = extract_documents(src, m, tag=False, **kw)
    return src, docs, rejects


def test_flat_feed_documents(spark, log_file):
    src, docs, rejects = _docs(spark, log_file)
    assert sorted(r["schema_identifier"] for r in docs["Houses"].collect()) == ["H0", "H1"]
    assert docs["Probes"].count() == 6 and all(r.count() == 0 for r in rejects.values())
    logs = {r["schema_identifier"]: r for r in docs["Logs"].collect()}
    assert set(logs) == {f"H{h}__240s_{k}" for h in (0, 1) for k in (1, 2, 3)}  # 20 x 30 s from the minimum
    curves = [m for r in logs.values() for m in r["probes"]]
    assert all(m["unit"] == "celsius" for m in curves)  # Q5: nested literals are kept
    for r in logs.values():
        ids = [m["n_id"] for m in r["probes"]]
        assert ids == sorted(ids)  # Q20: deterministic order
        assert r["points_cols"] == ["temp", "a_id", "humid_"] or r["points_cols"] == ["temp", "humid_", "a_id"]
    assert sum(map(n_points, logs.values())) == src.count()
    assert isinstance(curves[0]["points"][0][0], float)


def test_round_trip_equals_distinct_source(spark, log_file):
    src, docs, _ = _docs(spark, log_file)
    logs = docs["Logs"]
    members = logs.select("points_cols").first()[0]
    rows = expand_tuples(expand_collection(logs, "probes", keep=[]), "points", members, keep=["n_id"])
    got = rows.select(F.col("a_id").cast("long"), F.col("n_id").cast("int"), F.col("temp").cast("double"))
    want = src.select("stamp", "probe", "temp").distinct()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _line(stamp, probe, house="H0"):
    return f"{stamp}|{house}|B0|{probe}|1.5|40|"


def test_partition_keeps_the_tail(spark, local_dir):
    # five readings one second apart; a 2 s interval: the span (4 s) is an exact multiple
    path = write_log(local_dir, "tail.csv", [_line(1000 * t, 1) for t in range(5)])
    body = dict(LOG_MAPPING["data"]["Logs"][0], partition={"interval": "2s", "ts_field": "stamp"})
    _, docs, _ = _docs(spark, path, dict(LOG_MAPPING, data={"Logs": [body]}))
    keys = sorted(r[0] for r in docs["Logs"].select("schema_identifier").collect())
    assert keys == ["H0__2s_1", "H0__2s_2", "H0__2s_3"]
    assert sum(map(n_points, docs["Logs"].collect())) == 5
    ms = spark.range(5).select((F.col("id") * 1000).alias("ms"))  # Q1: the legacy loop lost the row at the maximum
    assert timeparts.assign_partition(ms, "ms", 2000, tail="drop").count() == 4


def test_rows_without_a_usable_time_are_rejected(spark, local_dir):
    lines = [_line(1000, 1), _line("soon", 2), _line("", 3), _line(2000, 4, house="")]
    path = write_log(local_dir, "bad.csv", lines)
    _, docs, rejects = _docs(spark, path)
    assert sum(map(n_points, docs["Logs"].collect())) == 1
    got = sorted((r["schema_identifier"] or "", r["reason"]) for r in rejects["Logs"].collect())
    assert got == [("", "NO_KEY"), ("H0", "NO_TIMESTAMP"), ("H0", "NO_TIMESTAMP")]
    # a pattern that fits no row: every row is reported, none is lost
    wrong = dict(LOG_MAPPING, file=dict(LOG_MAPPING["file"], timestamp_format="yyyy/MM/dd"))
    _, docs, rejects = _docs(spark, path, wrong)
    assert docs["Logs"].count() == 0 and rejects["Logs"].count() == 4


def test_duplicates_collapse_and_rejects(spark, local_dir):
    lines = [_line(1000, 1), _line(1000, 1), _line(1000, 2), _line(2000, "")]
    _, docs, rejects = _docs(spark, write_log(local_dir, "dups.csv", lines))
    assert n_points(docs["Logs"].first()) == 3  # Q23: exact duplicates collapse
    assert rejects["Probes"].count() == 1  # Q17: a row without key is rejected, not imported
    assert docs["Probes"].count() == 2


def test_outer_array_with_nested_collection(spark, log_file):
    # Q8: a document with both a top-level tuple array and a nested collection
    d = parse_definition("Houses", {"a": "collection", "schema_identifier": "house",
                                    "fitted": {"a": "nested_array", "a_id": "probe", "bed": "bed"},
                                    "times": {"a": "nested_collection", "n_id": "stamp",
                                              "seen": {"a": "nested_array", "a_id": "probe"}}})
    src = read_source(spark, {"format": "csv", "delimiter": "|", "header": "True"}, log_file)
    docs = extract_definition(src, d).orderBy("schema_identifier").collect()
    assert len(docs) == 2
    assert docs[0]["fitted_cols"] == ["a_id", "bed"] and docs[0]["seen_cols"] == ["a_id"]
    assert all(len(r["fitted"]) == 3 and len(r["times"]) >= 1 for r in docs)


def test_outer_array_with_nested_collection_keeps_null_keys(spark):
    # Q8 with a null group attribute: both aggregates and their join keep the null-key document
    d = parse_definition("C", {"a": "collection", "schema_identifier": "k", "grp": "g",
                               "tags": {"a": "nested_array", "a_id": "t"},
                               "items": {"a": "nested_collection", "n_id": "i"}})
    src = spark.createDataFrame([("a", None, 1, 10), ("a", None, 2, 11), ("a", "x", 3, 12), (None, None, 4, 13)],
                                "k string, g string, t int, i int")
    docs = {(r["schema_identifier"], r["grp"]): r for r in extract_definition(src, d).collect()}
    assert set(docs) == {("a", None), ("a", "x"), (None, None)}
    assert [t[0] for t in docs[("a", None)]["tags"]] == [1, 2]
    assert [it["n_id"] for it in docs[("a", None)]["items"]] == [10, 11]
    assert [it["n_id"] for it in docs[(None, None)]["items"]] == [13]


def test_to_documents_omits_nulls(spark):
    df = spark.createDataFrame([("a", None, 1)], "schema_identifier string, x string, y int")
    doc = to_documents(df).first()["document"]
    assert doc == '{"schema_identifier":"a","y":1}'


def test_split_rejected(spark):
    df = spark.createDataFrame([("a",), (None,)], "schema_identifier string")
    ok, bad = split_rejected(df)
    assert ok.count() == 1 and bad.count() == 1


def test_group_documents_clusters_without_folding(spark, local_dir):
    from trackmodel.operators.nest import group_documents, write_grouped
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "schema_identifier string, g int")
    rows = group_documents(df, "g").collect()
    assert sorted((r["g"], r["document"]) for r in rows) == [
        (1, '{"schema_identifier":"a","g":1}'), (1, '{"schema_identifier":"b","g":1}'),
        (2, '{"schema_identifier":"c","g":2}')]
    path = os.path.join(local_dir, "grouped")
    write_grouped(df, "g", path)
    assert sorted(n for n in os.listdir(path) if n.startswith("g=")) == ["g=1", "g=2"]


def test_group_documents_splits_a_hot_group(spark):
    """One group holding most documents is cut across several tasks, kept in order and whole."""
    from pyspark.sql import functions as F

    from trackmodel.operators.nest import group_documents
    n = 4000
    df = spark.range(n).select(F.col("id").cast("string").alias("schema_identifier"),
                               F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(100)).alias("g"))
    out = group_documents(df, "g")
    # a tiny input would otherwise be coalesced into one partition by AQE
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_part = out.withColumn("p", F.spark_partition_id()).groupBy("p", "g").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot_parts = {r["p"] for r in per_part if r["g"] == 100}
    assert len(hot_parts) > 1
    assert out.count() == n and out.filter("g = 100").count() == n - (n + 2) // 3
    # groups stay contiguous: partition ids of consecutive groups never interleave
    spans = {}
    for r in per_part:
        lo, hi = spans.get(r["g"], (r["p"], r["p"]))
        spans[r["g"]] = (min(lo, r["p"]), max(hi, r["p"]))
    ordered = sorted(spans.values())
    assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_constant_documents_need_rows(spark):
    d = parse_definition("Sites", {"a": "collection", "schema_identifier": "dshs#mapping_1",
                                   "steps": {"a": "nested_collection", "n_id": "t"}})
    src = spark.createDataFrame([(1,), (2,)], "t int")
    docs = extract_definition(src, d).collect()
    assert len(docs) == 1 and [m["n_id"] for m in docs[0]["steps"]] == [1, 2]
    assert extract_definition(src.limit(0), d).count() == 0
    flat = parse_definition("Sites", {"a": "collection", "schema_identifier": "dshs#mapping_1"})
    assert extract_definition(src, flat).collect()[0]["schema_identifier"] == "1"
    assert extract_definition(src.limit(0), flat).count() == 0

"""Property tests: invariants that must hold for any input (SURVEY §5 (d))."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackmodel.functions.columns import urlify_col
from trackmodel.functions.pointers import urlify
from trackmodel.operators.nest import expand_collection, expand_tuples
from trackmodel.operators.timeparts import assign_partition
from trackmodel.plans.extract import extract_definition
from trackmodel.plans.mapping import parse_definition

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

ascii_text = st.text(alphabet=string.ascii_letters + string.digits + " _/#.-()$%\t", max_size=30)


@SETTINGS
@given(st.lists(ascii_text, min_size=1, max_size=20))
def test_urlify_same_on_driver_and_data(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(urlify_col("s")).collect()] == [urlify(n) for n in names]


rows = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 4), st.integers(-5, 5)),
                min_size=1, max_size=60)


@SETTINGS
@given(rows)
def test_nest_then_expand_is_distinct_source(spark, data):
    src = spark.createDataFrame(data, "g int, t int, p int, x int")
    d = parse_definition("S", {"a": "collection", "schema_identifier": "g",
                               "moments": {"a": "nested_collection", "n_id": "t",
                                           "who": {"a": "nested_array", "a_id": "p", "x": "x"}}})
    docs = extract_definition(src, d)
    back = expand_tuples(expand_collection(docs, "moments", keep=["schema_identifier"]), "who", ["a_id", "x"],
                         keep=["schema_identifier", "n_id"])
    got = sorted((int(r.schema_identifier), r.n_id, int(r.a_id), int(r.x)) for r in back.collect())
    assert got == sorted(set(data))


@SETTINGS
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=80), st.integers(1, 3000))
def test_slices_cover_every_row_once(spark, ms, width):
    df = spark.createDataFrame([(m,) for m in ms], "ms long")
    p = assign_partition(df, "ms", width, bucket="k").collect()
    lo = min(ms)
    assert sorted((r.ms, r.k) for r in p) == sorted((m, (m - lo) // width + 1) for m in ms)
    dropped = assign_partition(df, "ms", width, tail="drop").count()
    n_legacy = -(-(max(ms) - lo) // width)
    assert dropped == sum(1 for m in ms if m < lo + n_legacy * width)


def _py_merge(new, old):
    """Reference rule on plain values: incoming wins, structs merge per field, null means absent."""
    if isinstance(new, dict) or isinstance(old, dict):
        if new is None and old is None:
            return None
        new, old = new or {}, old or {}
        return {k: _py_merge(new.get(k), old.get(k)) for k in sorted(set(new) | set(old))}
    return new if new is not None else old


maybe_int = st.none() | st.integers(-3, 3)
maybe_txt = st.none() | st.sampled_from(["a", "b", ""])
struct_val = st.none() | st.fixed_dictionaries({"x": maybe_int, "y": maybe_txt})
doc = st.fixed_dictionaries({"n": maybe_int, "t": maybe_txt, "s": struct_val})


@SETTINGS
@given(st.lists(st.tuples(doc, doc), min_size=1, max_size=40))
def test_merge_matches_deep_merge_rule(spark, pairs):
    from pyspark.sql import types as T

    from trackmodel.operators.upsert import merge_columns

    s_type = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])
    types = {"n": T.LongType(), "t": T.StringType(), "s": s_type}
    fields = [T.StructField("i", T.LongType())]
    for side in ("new", "old"):
        fields += [T.StructField(f"{side}_{c}", t) for c, t in types.items()]
    def st_(v):
        return None if v is None else (v["x"], v["y"])

    data = [(i, new["n"], new["t"], st_(new["s"]), old["n"], old["t"], st_(old["s"]))
            for i, (new, old) in enumerate(pairs)]
    df = spark.createDataFrame(data, T.StructType(fields))
    merged = merge_columns(types, types, lambda c: df[f"new_{c}"], lambda c: df[f"old_{c}"])
    got = {r["i"]: r for r in df.select("i", *merged).collect()}
    for i, (new, old) in enumerate(pairs):
        want = _py_merge(new, old)
        r = got[i]
        have = {"n": r["n"], "t": r["t"], "s": None if r["s"] is None else r["s"].asDict()}
        assert have == want, (new, old)

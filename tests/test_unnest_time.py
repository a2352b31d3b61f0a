import pytest
from pyspark.sql import functions as F

from trackmodel.functions.columns import to_epoch_ms, urlify_col
from trackmodel.operators import timeparts
from trackmodel.operators.unnest import unnest


@pytest.fixture()
def nested(spark):
    return spark.createDataFrame(
        [(1, [1, 2, 3], ["a"], [[10, 11], [12]]), (2, [], ["b", "c"], None), (3, None, None, [[]])],
        "k int, xs array<int>, ys array<string>, zz array<array<int>>")


def test_explode_drops_or_keeps_empty(spark, nested):
    u, a = unnest(nested, [("xs",)])
    assert sorted(r.k for r in u.select("k").collect()) == [1, 1, 1]
    u, a = unnest(nested, [("xs",)], outer=True)
    assert sorted((r.k, r.v) for r in u.select("k", F.col(a[("xs",)]).alias("v")).collect()) == \
        [(1, 1), (1, 2), (1, 3), (2, None), (3, None)]


def test_siblings_are_position_aligned(spark, nested):
    u, a = unnest(nested, [("xs",), ("ys",)])
    got = sorted((r.k, r.x, r.y) for r in u.select("k", F.col(a[("xs",)]).alias("x"),
                                                     F.col(a[("ys",)]).alias("y")).collect())
    # never a product: row count is the longest sibling per row
    assert got == [(1, 1, "a"), (1, 2, None), (1, 3, None), (2, None, "b"), (2, None, "c")]


def test_array_of_arrays_and_index(spark, nested):
    u, a = unnest(nested, [("zz",)])
    inner = F.col(a[("zz",)])
    got = sorted((r.k, r.first, r.third) for r in u.select("k", F.get(inner, F.lit(0)).alias("first"),
                                                           F.get(inner, F.lit(2)).alias("third")).collect())
    assert got == [(1, 10, None), (1, 12, None), (3, None, None)]


def test_unnest_rejects_scalars(spark, nested):
    with pytest.raises(ValueError):
        unnest(nested, [("k",)])


def test_epoch_ms_forms(spark):
    df = spark.createDataFrame([("1550663557050", 1550663557050, "2020-01-01T12:00:00.040+01:00", "junk")],
                               "a string, b long, c string, d string")
    row = df.select(to_epoch_ms(F.col("a"), df.schema["a"].dataType).alias("a"),
                    to_epoch_ms(F.col("b"), df.schema["b"].dataType).alias("b"),
                    to_epoch_ms(F.col("c"), df.schema["c"].dataType, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("c"),
                    to_epoch_ms(F.col("d"), df.schema["d"].dataType).alias("d")).first()
    assert row.a == 1550663557050 and row.b == 1550663557050
    assert row.c == 1577876400040  # milliseconds kept (Q3)
    assert row.d is None  # unparsable text is null, not an error under ANSI


def test_partition_counts_and_bounds(spark):
    df = spark.createDataFrame([(0,), (1999,), (2000,), (4000,), (None,)], "ms long")
    p = timeparts.assign_partition(df, "ms", 2000, bucket="k")
    assert {(r.ms, r.k) for r in p.collect()} == {(0, 1), (1999, 1), (2000, 2), (4000, 3), (None, None)}
    c = timeparts.partition_count(df, "ms", 2000).first()
    assert (c.n_slices, c.n_slices_legacy) == (3, 2)
    b = timeparts.time_bounds(df, "ms").first()
    assert (b.min_ms, b.max_ms) == (0, 4000)
    one = spark.createDataFrame([(5,)], "ms long")  # min == max: the legacy loop emitted nothing
    assert timeparts.assign_partition(one, "ms", 2000, tail="drop").count() == 0
    assert timeparts.assign_partition(one, "ms", 2000).count() == 1


def test_urlify_on_data(spark):
    df = spark.createDataFrame([("speed in m/s",), ("Brand#17  x",)], "s string")
    assert [r[0] for r in df.select(urlify_col("s")).collect()] == ["speed_in_ms", "Brand17_x"]

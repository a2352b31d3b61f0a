"""What an executor hands to a Python worker at once follows bytes, not rows alone."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackmodel.llm import common, sharding

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SCAN_CONF = "spark.sql.parquet.columnarReaderBatchSize"
TEXT = 2_000


@pytest.fixture
def session(spark):
    """The session as it was, without a bound of its own; as it was again afterwards."""
    own = spark.conf.getAll.get(CONF)
    spark.conf.unset(CONF)
    yield spark
    spark.conf.unset(CONF) if own is None else spark.conf.set(CONF, own)


def _texts(spark, rows):
    return spark.range(0, rows, 1, 1).select("id", F.repeat(F.lit("x"), TEXT).alias("text"))


def _sizes(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return [tuple(r) for r in common.map_arrow(df, sizes, "n long, size long").collect()]


def test_batches_are_bounded_in_bytes(session):
    got = _sizes(_texts(session, 10_000))
    assert sum(n for n, _ in got) == 10_000 and sum(size for _, size in got) > 10_000 * TEXT
    assert max(size for _, size in got) < common.BATCH_BYTES + 2 * TEXT


def test_a_row_beyond_the_bound_is_a_batch(session):
    long = session.range(0, 3, 1, 1).select(F.repeat(F.lit("x"), 2 * common.BATCH_BYTES).alias("text"))
    assert [n for n, _ in _sizes(long)] == [1, 1, 1]


def test_a_session_keeps_its_own_bound(session):
    session.conf.set(CONF, "1m")
    got = _sizes(_texts(session, 2_000))
    assert session.conf.get(CONF) == "1m" and max(size for _, size in got) < (1 << 20) + 2 * TEXT


def test_groups_beyond_the_bound_come_whole(session):
    common._ship(session)
    rows = common.BATCH_BYTES // TEXT * 2
    texts = _texts(session, rows).withColumn("g", F.lit(1))
    seen = texts.groupBy("g").applyInPandas(lambda g: g[["g"]].head(1).assign(n=len(g)), "g int, n long").collect()
    assert [r["n"] for r in seen] == [rows]


@pytest.fixture
def scans(spark, tmp_path, monkeypatch):
    """How many rows scans decode at once while shards' tables are staged, by table; and documents in Parquet."""
    rows = [(i, f"text {i % 40}") for i in range(400)] + [(None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    seen, stage = {}, common.staged

    def staged(df, name):
        seen.setdefault(name, []).append(spark.conf.get(SCAN_CONF))
        return stage(df, name)

    monkeypatch.setattr(common, "staged", staged)
    own = spark.conf.getAll.get(SCAN_CONF)
    spark.conf.unset(SCAN_CONF)
    yield spark.read.parquet(str(tmp_path / "documents")), seen
    spark.conf.unset(SCAN_CONF) if own is None else spark.conf.set(SCAN_CONF, own)


def test_sharding_scans_texts_in_small_batches(spark, scans):
    docs, seen = scans
    assert sharding.balanced_shards(docs, [F.md5(F.col("text"))], 4).count() == 401
    assert seen["rows"] == ["256"]
    assert set(seen["classes"] + seen["slots"]) == {"4096"}  # tables without texts: as Spark has it
    assert SCAN_CONF not in spark.conf.getAll


def test_sharding_leaves_the_scans_of_a_session_that_set_them(spark, scans):
    docs, seen = scans
    spark.conf.set(SCAN_CONF, "1000")
    assert sharding.balanced_shards(docs, [F.md5(F.col("text"))], 4).count() == 401
    assert {n for v in seen.values() for n in v} == {"1000"} and spark.conf.get(SCAN_CONF) == "1000"


def test_small_scans_end_with_an_error(spark, scans):
    with pytest.raises(ValueError):
        with common.small_scans(spark):
            assert spark.conf.get(SCAN_CONF) == str(common.SCAN_ROWS)
            raise ValueError
    assert SCAN_CONF not in spark.conf.getAll

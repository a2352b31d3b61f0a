"""Shared helpers of the training-data operators: staging, gapless ranks, text chunks inside a task."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: UTF-8 bytes of text a task turns into Python or numpy objects at once (a longer single text is one chunk).
CHUNK_BYTES = 1 << 20

#: Bytes of rows that an executor hands to a Python worker at once. Spark goes by 10,000 rows or 64 MB, which the
#: executor's buffers (doubled as they grow, kept when freed) and the worker both hold beside their own memory.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows that a scan decodes at once under :func:`small_scans`. Spark's 4,096 whole texts make arrays of tens of MB in
#: each task, which the executor's heap grows by although they are garbage soon after.
SCAN_ROWS = 256
_SCAN_CONF = "spark.sql.parquet.columnarReaderBatchSize"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the folder is visible to them (else use --py-files).

    Arrow's memory comes from the C library there, which gives freed memory back (:func:`release_memory`). Batches
    sent to workers are bounded in bytes, unless the session has its own bound.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), ROOT]))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


@contextmanager
def small_scans(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside decode ``SCAN_ROWS`` rows of Parquet at once, unless the session has its own number."""
    own = _SCAN_CONF in spark.conf.getAll
    if not own:
        spark.conf.set(_SCAN_CONF, str(SCAN_ROWS))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(_SCAN_CONF)


#: How to drop what a worker keeps between the tasks of one operator (tables of a tokenizer, say).
_FORGET: list[Callable[[], object]] = []
_busy_with: list[str] = []


def kept_by_worker(forget: Callable[[], object]) -> None:
    """Register what to call when a worker goes on to another operator's tasks."""
    _FORGET.append(forget)


def release_memory() -> None:
    """Give memory that a task has freed back to the system: workers live on, and their sizes would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _c_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc: nothing to trim
        return None


_TRIM = _c_trim()


def map_arrow(df: DataFrame, fn: Callable, schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` whose workers keep nothing of an earlier operator and give back what a task has freed."""
    _ship(df.sparkSession)
    owner = owner or fn.__module__

    def task(batches):
        if owner != __name__ and _busy_with != [owner]:  # helpers of this module belong to whoever calls them
            for forget in _FORGET:
                forget()
            _busy_with[:] = [owner]
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(task, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table of ``staged`` that nothing reads any more."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast when it is counted at ``max_rows`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_hot(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], weight: str, total: int) -> DataFrame:
    """Left join with a ``right`` that has each key once and, in ``weight``, how many rows of ``left`` share it.

    Keys with over a thousandth of the ``total`` rows (a thousand keys at most) are broadcast, so their rows stay
    where they are; the others are joined by a shuffle that no key dominates. ``left`` is read twice: stage it.
    """
    hot = F.broadcast(right.filter(F.col(weight) * 1000 > total))
    cold = right.filter(F.col(weight) * 1000 <= total)
    same = lambda r: [left[a].eqNullSafe(r[b]) for a, b in on]
    rest = left.join(hot, same(hot), "left_anti")
    return left.join(hot, same(hot)).unionByName(rest.join(cold, [F.col(a) == F.col(b) for a, b in on], "left"))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of text each, every row in one slice."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        block = np.cumsum(size) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [b.num_rows]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield b.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    return [t or "" for t in batch.column(text).to_pylist()]


def numbered(df: DataFrame, group: str, name: str, fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Stage ``df`` with ``part`` (task) and ``local`` (place among the task's rows of ``group``, from 0).

    Together with ``group`` they name a row for good: later reads see what the task committed. ``fn`` (as of
    :func:`map_arrow`, with the ``schema`` of its rows) makes the rows from those of ``df`` in the same worker.
    """
    fields = (df.schema if fn is None else T._parse_datatype_string(schema)).fields
    columns = [f.name for f in fields]
    at = columns.index(group)

    def count(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches if fn is None else fn(batches):
            if not b.num_rows:
                continue
            code = b.column(at).dictionary_encode()
            keys = code.dictionary.to_pylist()
            ids = pc.fill_null(code.indices, len(keys)).to_numpy(zero_copy_only=False).astype(np.int64)
            keys.append(None)
            order = np.argsort(ids, kind="stable")
            n = np.bincount(ids, minlength=len(keys))
            start = np.concatenate(([0], np.cumsum(n)[:-1]))
            local = np.empty(len(ids), np.int64)
            local[order] = np.arange(len(ids)) - np.repeat(start, n)
            local += np.array([seen.get(k, 0) for k in keys], np.int64)[ids]
            for k, c in zip(keys, n.tolist()):
                seen[k] = seen.get(k, 0) + c
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(local)], [*columns, "part", "local"])

    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return staged(map_arrow(df, count, f"{shown}, part int, local long", fn and fn.__module__), name)


def ranked(df: DataFrame, group: str) -> DataFrame:
    """``rank`` of each row of a ``numbered`` table within its group: gapless from 0, no group in one task.

    Only the counts of (group, task) are put in order; each row adds its task's offset to its place.
    """
    from pyspark.sql import Window

    counts = df.groupBy(group, "part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("part").alias("_p"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (df.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
            .withColumn("rank", F.col("local") + F.col("_o")).drop("_g", "_p", "_o"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            max_rows: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows whose id and text hash are in ``keys`` (``id_col``, ``text_hash``); nulls are equal."""
    gone = small_side(keys.select(F.col(id_col).alias("gone_id"), F.col("text_hash").alias("gone_hash")), max_rows)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (
        F.xxhash64(docs[text_col].cast("string")) == gone["gone_hash"]), "left_anti")

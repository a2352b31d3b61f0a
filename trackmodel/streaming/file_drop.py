"""Continuous import of provider files dropped into a folder, with Structured Streaming.

Each micro-batch takes whole files (``maxFilesPerTrigger``) and is imported exactly like a one-off import
(documents -> staged plan -> apply into the store) inside ``foreachBatch``. Time slices
count from the epoch unless the mapping's partition names another ``origin_ms``, so keys and content do not
depend on which files share a batch. Files that meet in one slice of one key add up: the nested arrays of a
stored slice keep their elements and gain the new ones, as if the files had been one. (Arrays of definitions
without a partition are replaced whole, as in any merge.) A batch that is re-run after
a failure applies the same documents again, which only re-confirms them (unchanged ``_etag``), so the
store converges to the same state. Records that do not parse are rejected with their text and file, as in a one-off
import. Progress is kept in ``checkpoint_location`` (a shared folder).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trackmodel.plans.ingest import apply_import, plan_import
from trackmodel.plans.mapping import Mapping, parse_mapping
from trackmodel.session import scratch_path
from trackmodel.sources.files import read_records, read_source
from trackmodel.sources.store import CollectionStore


def file_drop_import(spark: SparkSession, mapping: dict | Mapping, folder: str, store: CollectionStore,
                     checkpoint_location: str, inputs: dict | None = None, schema=None, files_per_batch: int = 1,
                     available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start importing every file that appears in ``folder``; returns the running query.

    ``schema`` defaults to the one inferred from the files already in the folder (a streaming file
    source needs a fixed schema); pass it explicitly for a folder that starts empty.
    """
    m = mapping if isinstance(mapping, Mapping) else parse_mapping(mapping, inputs)
    for d in m.definitions():
        if d.partition and d.partition.origin_ms is None:
            d.partition = replace(d.partition, origin_ms=0)
    infer_types = None if schema is None else False
    if schema is None:
        schema = read_source(spark, m.file, folder).schema

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        ip = plan_import(spark, m, batch, store, stage_dir=scratch_path(spark, f"stream-batch-{batch_id}"),
                         grow_slices=True, infer_types=infer_types)
        apply_import(spark, ip, store)

    files = read_records(spark, m.file, folder, schema, stream=True, maxFilesPerTrigger=files_per_batch)
    w = files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()

"""Table-level operators: unnest, time partitions, re-nest, upsert, reports."""

import importlib

_EXPORTS = {
    "expand_collection": "trackmodel.operators.nest",
    "expand_tuples": "trackmodel.operators.nest",
    "group_documents": "trackmodel.operators.nest",
    "nest_array": "trackmodel.operators.nest",
    "nest_collection": "trackmodel.operators.nest",
    "to_documents": "trackmodel.operators.nest",
    "with_cols_index": "trackmodel.operators.nest",
    "import_counts": "trackmodel.operators.report",
    "import_outcome": "trackmodel.operators.report",
    "with_provenance": "trackmodel.operators.report",
    "assign_partition": "trackmodel.operators.timeparts",
    "normalize_ts": "trackmodel.operators.timeparts",
    "partition_count": "trackmodel.operators.timeparts",
    "partition_suffix": "trackmodel.operators.timeparts",
    "time_bounds": "trackmodel.operators.timeparts",
    "time_range_filter": "trackmodel.operators.timeparts",
    "explode_one": "trackmodel.operators.unnest",
    "unnest": "trackmodel.operators.unnest",
    "apply_plan": "trackmodel.operators.upsert",
    "batch_duplicates": "trackmodel.operators.upsert",
    "dedup_plan": "trackmodel.operators.upsert",
    "delete_by_key": "trackmodel.operators.upsert",
    "merge_columns": "trackmodel.operators.upsert",
    "plan_upsert": "trackmodel.operators.upsert",
    "replace_by_key": "trackmodel.operators.upsert",
}

__all__ = list(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)

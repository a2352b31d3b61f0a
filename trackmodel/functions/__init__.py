"""Driver-side pointer helpers and JVM-side column expressions."""

import importlib

_EXPORTS = {
    "SYSTEM_COLUMNS": "trackmodel.functions.columns",
    "canonical_json": "trackmodel.functions.columns",
    "doc_id_col": "trackmodel.functions.columns",
    "etag_col": "trackmodel.functions.columns",
    "parse_interval": "trackmodel.functions.columns",
    "to_epoch_ms": "trackmodel.functions.columns",
    "uniform_array": "trackmodel.functions.columns",
    "urlify_col": "trackmodel.functions.columns",
    "json_array": "trackmodel.functions.columns",
    "Pointer": "trackmodel.functions.pointers",
    "apply_steps": "trackmodel.functions.pointers",
    "parse_pointer": "trackmodel.functions.pointers",
    "urlify": "trackmodel.functions.pointers",
}

__all__ = list(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)

"""Sources: provider files (CSV/JSON/XML), schema description, and the versioned collection store."""

import importlib

_EXPORTS = {
    "read_csv": "trackmodel.sources.files",
    "read_json": "trackmodel.sources.files",
    "read_source": "trackmodel.sources.files",
    "read_xml": "trackmodel.sources.files",
    "describe_schema": "trackmodel.sources.schema",
    "CollectionStore": "trackmodel.sources.store",
    "business_columns": "trackmodel.sources.store",
    "strip_system": "trackmodel.sources.store",
    "with_system": "trackmodel.sources.store",
}

__all__ = list(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)

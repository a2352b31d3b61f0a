"""Plans: mapping specs, per-definition extraction, and the end-to-end import."""

import importlib

_EXPORTS = {
    "extract_collection": "trackmodel.plans.extract",
    "extract_definition": "trackmodel.plans.extract",
    "feature_constants": "trackmodel.plans.extract",
    "split_rejected": "trackmodel.plans.extract",
    "union_definitions": "trackmodel.plans.extract",
    "ImportPlan": "trackmodel.plans.ingest",
    "apply_import": "trackmodel.plans.ingest",
    "extract_documents": "trackmodel.plans.ingest",
    "plan_import": "trackmodel.plans.ingest",
    "stage_plan": "trackmodel.plans.ingest",
    "Mapping": "trackmodel.plans.mapping",
    "parse_definition": "trackmodel.plans.mapping",
    "parse_mapping": "trackmodel.plans.mapping",
}

__all__ = list(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)

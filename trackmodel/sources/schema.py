"""Schema description of a source: pre-order rows ``(ord, level, name, path, type)`` plus, for every
node, the number of non-null values found, computed by one aggregation over the data (S8).

Array elements that are not structs get an ``_element`` row one level deeper; struct elements list their
fields. Counts under arrays count elements (``transform``/``flatten`` keep this inside one pass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LABEL = {T.StructType: "struct", T.ArrayType: "array", T.MapType: "map"}


def type_label(dt: T.DataType) -> str:
    for cls, lab in _LABEL.items():
        if isinstance(dt, cls):
            return lab
    return dt.typeName()


def _nodes(dt: T.DataType, level: int, path: str, vals: "_Vals", out: list) -> None:
    if isinstance(dt, T.StructType):
        for f in dt.fields:
            p = f"{path}.{f.name}" if path else f.name
            fv = _field_values(vals, f.name)
            out.append((level, f.name, p, f.dataType, fv))
            _nodes(f.dataType, level + 1, p, fv, out)
    elif isinstance(dt, T.ArrayType):
        ev = _flatten_values(vals)
        if isinstance(dt.elementType, T.StructType):
            _nodes(dt.elementType, level, path, ev, out)
        else:
            p = f"{path}[]"
            out.append((level, "_element", p, dt.elementType, ev))
            _nodes(dt.elementType, level + 1, p, ev, out)


class _Vals:
    """How to reach the values of a node: a column expression plus whether it is a list of values."""

    def __init__(self, col: Column | None, is_list: bool):
        self.col, self.is_list = col, is_list


def _field_values(v: _Vals, name: str) -> _Vals:
    if v.col is None:
        return _Vals(F.col(f"`{name}`"), False)
    if v.is_list:
        return _Vals(F.transform(v.col, lambda x: x.getField(name)), True)
    return _Vals(v.col.getField(name), False)


def _flatten_values(v: _Vals) -> _Vals:
    # the node's values are arrays: turn them into a list of elements
    if v.is_list:
        return _Vals(F.flatten(F.filter(v.col, lambda x: x.isNotNull())), True)  # a null inner array holds nothing
    return _Vals(v.col, True)


def _count(v: _Vals) -> Column:
    if v.is_list:
        return F.sum(F.coalesce(F.size(F.filter(v.col, lambda x: x.isNotNull())), F.lit(0))).cast("long")
    return F.count(v.col)


def describe_schema(df: DataFrame) -> DataFrame:
    """``(ord, level, name, path, type, non_null)`` for every node of ``df``'s schema, in pre-order."""
    nodes: list = []
    _nodes(df.schema, 0, "", _Vals(None, False), nodes)
    counts = df.agg(*[_count(v).alias(f"c{i}") for i, (_, _, _, _, v) in enumerate(nodes)])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"), F.lit(name).alias("name"),
                              F.lit(path).alias("path"), F.lit(type_label(dt)).alias("type"),
                              F.col(f"c{i}").alias("non_null"))
                     for i, (level, name, path, dt, _) in enumerate(nodes)])
    # one aggregate row (partial counts per task, merged once) unpivoted into one row per schema node
    return counts.select(F.inline(rows))

"""Types of text leaves, decided from the values themselves.

A leaf is named by its path: field names joined by dots, whatever arrays lie between (``Track.Point._v``). One
aggregate over the leaves in question tells the narrowest of long, double, boolean and text that holds every
value of a leaf as written: ``007`` and ``1e999`` stay text, and so does a leaf that mixes fractions with whole
numbers beyond 2^53. Blank text is no value; a leaf without values stays text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.types import conform, lossy

_LONG = r"^(0|-?[1-9][0-9]{0,18})$"
_DOUBLE = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def text_leaves(schema: T.StructType) -> list[str]:
    """Paths of the string leaves of a schema (maps are not entered)."""
    out: list[str] = []

    def walk(dt: T.DataType, path: str) -> None:
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(dt, T.ArrayType):
            walk(dt.elementType, path)
        elif isinstance(dt, T.StringType):
            out.append(path)

    walk(schema, "")
    return list(dict.fromkeys(out))


def _typed(dt: T.DataType, types: dict[str, T.DataType], path: str = "") -> T.DataType:
    """``dt`` with the leaves of ``types`` retyped."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _typed(f.dataType, types, f"{path}.{f.name}" if path else f.name))
                             for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_typed(dt.elementType, types, path))
    return types.get(path, dt) if not isinstance(dt, T.MapType) else dt


def _values(schema: T.StructType, leaf: str) -> Column:
    """All values of a leaf in a record, as one array."""
    field = next(f for f in schema.fields if leaf == f.name or leaf.startswith(f"{f.name}."))
    c, dt, rest = F.col(f"`{field.name}`"), field.dataType, leaf[len(field.name) + 1:]
    many = False
    while True:
        while isinstance(dt, T.ArrayType):
            many, dt = True, dt.elementType
            if isinstance(dt, T.ArrayType):
                c = F.flatten(c)
        if not rest:
            return c if many else F.array(c)
        inner = next(f for f in dt.fields if rest == f.name or rest.startswith(f"{f.name}."))
        c, dt, rest = c.getField(inner.name), inner.dataType, rest[len(inner.name) + 1:]
        if many and isinstance(dt, T.ArrayType):
            c = F.flatten(c)


def _blank(v: Column) -> Column:
    return v.isNull() | (F.trim(v) == "")


def _like(v: Column, pattern: str) -> Column:
    """``v`` where it looks like ``pattern``: only such text is tried as a number, for each failed try costs an exception."""
    return F.when(v.rlike(pattern), v)


def _as_long(v: Column) -> Column:
    return _like(v, _LONG).try_cast("long").isNotNull()


def _as_double(v: Column) -> Column:
    v = _like(v, _DOUBLE)
    finite = F.coalesce(F.abs(v.try_cast("double")) <= F.lit(1.7976931348623157e308), F.lit(False))
    return finite & ~lossy(v, T.StringType(), T.DoubleType())


def _as_boolean(v: Column) -> Column:
    return v.isin("true", "false")


def leaf_types(df: DataFrame, leaves: list[str]) -> dict[str, T.DataType]:
    """The narrowest type of each text leaf that is not text, from one aggregate over all values."""
    if not leaves:
        return {}
    each = F.array(*[F.struct(F.lit(i).alias("leaf"), _values(df.schema, p).alias("values")) for i, p in enumerate(leaves)])
    values = df.select(F.inline(each)).select("leaf", F.explode("values").alias("v")).filter(~_blank(F.col("v")))
    v = F.col("v")
    kind = F.when(_as_long(v), F.lit("long")).when(_as_double(v), F.lit("double")).when(
        _as_boolean(v), F.lit("boolean")).otherwise(F.lit("text"))
    # a whole number that no double has
    wide = (F.col("kind") == "long") & lossy(_like(v, _LONG).try_cast("long"), T.LongType(), T.DoubleType())
    # a flag per kind, not a set of them: plain columns, which hash aggregation keeps without objects
    names = ("long", "double", "boolean", "text")
    seen = values.withColumn("kind", kind).groupBy("leaf").agg(*[F.max(F.col("kind") == k).alias(k) for k in names], F.max(wide).alias("wide"))
    out: dict[str, T.DataType] = {}
    for leaf, *flags, beyond in seen.collect():  # a row per leaf
        kinds = {k for k, there in zip(names, flags) if there}
        if kinds == {"long"}:
            out[leaves[leaf]] = T.LongType()
        elif kinds == {"boolean"}:
            out[leaves[leaf]] = T.BooleanType()
        elif kinds <= {"long", "double"} and not beyond:
            out[leaves[leaf]] = T.DoubleType()
    return out


def retype(df: DataFrame, types: dict[str, T.DataType]) -> tuple[DataFrame, Column]:
    """(``df`` with its leaves in ``types``, whether a record of ``df`` holds a value that such a type cannot)."""
    known = text_paths(df.schema)
    unknown = sorted(set(types) - known)
    if unknown:
        raise ValueError(f"no such leaves: {', '.join(unknown)}; leaves: {', '.join(sorted(known))}")
    out, bad = [], F.lit(False)
    for f in df.schema.fields:
        to = _typed(f.dataType, types, f.name)
        c = _blank_as_null(F.col(f"`{f.name}`"), f.dataType, to)
        if to.simpleString() != f.dataType.simpleString():
            bad = bad | lossy(c, f.dataType, to)
        out.append(conform(c, f.dataType, to).alias(f.name))
    return df.select(*out), bad


def text_paths(schema: T.StructType) -> set[str]:
    """Paths of all leaves, of any type."""
    out: set[str] = set()

    def walk(dt: T.DataType, path: str) -> None:
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(dt, T.ArrayType):
            walk(dt.elementType, path)
        else:
            out.add(path)

    walk(schema, "")
    return out


def _blank_as_null(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    """``c`` with null for blank text of the leaves that ``dst`` types."""
    if src.simpleString() == dst.simpleString():
        return c
    if isinstance(src, T.StructType):
        to = {f.name: f.dataType for f in dst.fields}
        return F.when(c.isNotNull(), F.struct(*[_blank_as_null(c.getField(f.name), f.dataType, to[f.name]).alias(f.name)
                                                for f in src.fields]))
    if isinstance(src, T.ArrayType):
        return F.transform(c, lambda x: _blank_as_null(x, src.elementType, dst.elementType))
    return F.when(~_blank(c), c) if isinstance(src, T.StringType) else c

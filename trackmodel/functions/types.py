"""Common types of two versions of a document, by name and recursively, and columns rebuilt to them.

Structs unite their fields, arrays and maps recurse, numbers widen, nullability never matters. Where two
leaves have no common type the stored one holds: the incoming value is tried as that type, and
:func:`lossy` tells the rows whose value does not survive, so they can be rejected instead of retyped.

Some widenings depend on the values: a long beyond 2^53 is no double, digits may not fit one decimal type. Those
are steps that ``exact`` does not promise; they are taken only when no stored value is lost by them
(``common_type(..., strict=True)`` gives the types without them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def _rank(dt: T.DataType) -> int | None:
    return next((i for i, t in enumerate(_WIDTH) if isinstance(dt, t)), None)


#: Digits that each integral type may need.
_DIGITS = [3, 5, 10, 19]


def _as_decimal(dt: T.DataType) -> tuple[int, int] | None:
    """(digits before the point, digits after it) that hold every value of a decimal or integral type."""
    if isinstance(dt, T.DecimalType):
        return dt.precision - dt.scale, dt.scale
    return None if _rank(dt) is None else (_DIGITS[_rank(dt)], 0)


def _number(a: T.DataType, b: T.DataType) -> T.DataType:
    ra, rb = _rank(a), _rank(b)
    if ra is not None and rb is not None:
        return a if ra >= rb else b
    da, db = _as_decimal(a), _as_decimal(b)
    if da and db:
        scale = max(da[1], db[1])
        return T.DecimalType(min(38, max(da[0], db[0]) + scale), scale)
    return a if type(a) is type(b) else T.DoubleType()


def exact(src: T.DataType, dst: T.DataType) -> bool:
    """Whether every value of ``src`` is one of ``dst``, whatever the values are."""
    if same_type(src, dst) or isinstance(src, T.NullType):
        return True
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        to = {f.name: f.dataType for f in dst.fields}
        return all(f.name in to and exact(f.dataType, to[f.name]) for f in src.fields)
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        return exact(src.elementType, dst.elementType)
    if isinstance(src, T.MapType) and isinstance(dst, T.MapType):
        return exact(src.keyType, dst.keyType) and exact(src.valueType, dst.valueType)
    rs, rd = _rank(src), _rank(dst)
    if rs is not None and rd is not None:
        return rs <= rd
    if isinstance(dst, T.DoubleType):
        return isinstance(src, T.FloatType) or (rs is not None and not isinstance(src, T.LongType))
    ds, dd = _as_decimal(src), _as_decimal(dst)
    return bool(ds and dd and isinstance(dst, T.DecimalType) and ds[0] <= dd[0] and ds[1] <= dd[1])


def common_type(stored: T.DataType, incoming: T.DataType, strict: bool = False) -> T.DataType:
    """The type both sides are rebuilt to; ``stored`` where two leaves do not meet (``strict``: or do not meet in a
    type that holds every stored value)."""
    if isinstance(stored, T.NullType):
        return incoming
    if isinstance(incoming, T.NullType):
        return stored
    if isinstance(stored, T.StructType) and isinstance(incoming, T.StructType):
        new = {f.name: f.dataType for f in incoming.fields}
        fields = [T.StructField(f.name, common_type(f.dataType, new[f.name], strict) if f.name in new else f.dataType)
                  for f in stored.fields]
        known = {f.name for f in stored.fields}
        return T.StructType(fields + [T.StructField(n, dt) for n, dt in new.items() if n not in known])
    if isinstance(stored, T.ArrayType) and isinstance(incoming, T.ArrayType):
        return T.ArrayType(common_type(stored.elementType, incoming.elementType, strict))
    if isinstance(stored, T.MapType) and isinstance(incoming, T.MapType):
        return T.MapType(common_type(stored.keyType, incoming.keyType, strict),
                         common_type(stored.valueType, incoming.valueType, strict))
    if isinstance(stored, T.NumericType) and isinstance(incoming, T.NumericType):
        wide = _number(stored, incoming)
        return stored if strict and not exact(stored, wide) else wide
    return stored


def _nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StructType, T.ArrayType, T.MapType))


def same_type(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def conform(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    """``c`` (of type ``src``) rebuilt to ``dst``; leaves without a safe cast become null (see :func:`lossy`)."""
    if same_type(src, dst):
        return c
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        own = {f.name: f.dataType for f in src.fields}
        return F.when(c.isNotNull(), F.struct(*[
            (conform(c.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in dst.fields]))
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        return F.transform(c, lambda x: conform(x, src.elementType, dst.elementType))
    if isinstance(src, T.MapType) and isinstance(dst, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: conform(k, src.keyType, dst.keyType)),
                                  lambda _, v: conform(v, src.valueType, dst.valueType))
    if _nested(src) or _nested(dst):
        # a nested value where the other side holds a leaf: only its JSON text can stand for it
        return F.to_json(c) if isinstance(dst, T.StringType) else F.lit(None).cast(dst)
    return c.try_cast(dst)


def lossy(c: Column, src: T.DataType, dst: T.DataType) -> Column:
    """Whether ``conform`` would lose a value of ``c``."""
    if same_type(src, dst):
        return F.lit(False)
    if isinstance(src, T.StructType) and isinstance(dst, T.StructType):
        to = {f.name: f.dataType for f in dst.fields}
        parts = [lossy(c.getField(f.name), f.dataType, to[f.name]) for f in src.fields
                 if not same_type(f.dataType, to[f.name])]
        return F.coalesce(reduce(lambda a, b: a | b, parts, F.lit(False)), F.lit(False))
    if isinstance(src, T.ArrayType) and isinstance(dst, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: lossy(x, src.elementType, dst.elementType)), F.lit(False))
    if isinstance(src, T.MapType) and isinstance(dst, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: lossy(x, src.valueType, dst.valueType)), F.lit(False)) | F.coalesce(
            F.exists(F.map_keys(c), lambda x: lossy(x, src.keyType, dst.keyType)), F.lit(False))
    return c.isNotNull() & ~F.coalesce(_kept(c, conform(c, src, dst), src, dst), F.lit(False))


def _kept(c: Column, to: Column, src: T.DataType, dst: T.DataType) -> Column:
    """Whether ``to``, a leaf ``c`` cast to ``dst``, still has its value (null where the cast failed)."""
    if isinstance(dst, T.NumericType) and isinstance(src, T.NumericType) and not exact(src, dst):
        return to.try_cast(src) == c
    if isinstance(src, T.StringType) and isinstance(dst, (T.DoubleType, T.FloatType, T.DecimalType)):
        # the digits of a number in text: at most 19 before the point and 10 after it are compared
        digits = c.try_cast("decimal(38,10)")
        return to.isNotNull() & (digits.isNull() | (to.try_cast("decimal(38,10)") == digits))
    return to.isNotNull()


def overlay(new: Column, old: Column, dt: T.DataType) -> Column:
    """Both of type ``dt``: incoming wins, structs field by field, arrays and leaves whole, null is absent."""
    if isinstance(dt, T.StructType):
        return F.when(new.isNotNull() | old.isNotNull(), F.struct(*[
            overlay(new.getField(f.name), old.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]))
    return F.coalesce(new, old)

"""JSON lines as VARIANT: no inference pass, and every value keeps the type it was written with.

The pointers of a mapping say which parts of a record are wanted and where its arrays are; that gives the structure
of the frame, with VARIANT leaves. So an array that mixes a number, a text and a nested list stays what it is, and
``types`` of the mapping's ``file`` block (leaf path -> type, array places as ``[i]``) says what its members become.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.pointers import Pointer, parse_pointer
from trackmodel.sources.files import BROKEN, FILE


def leaf_path(p: Pointer) -> str:
    """Name of a pointer's leaf in ``types``: its steps joined by dots (``visits.log.[0]``)."""
    return ".".join([*p.explode, *[f"[{s}]" if isinstance(s, int) else s for s in p.steps]])


def pointer_schema(pointers: list[str]) -> T.StructType:
    """The structure that ``pointers`` walk: structs, arrays where they unnest or index, VARIANT leaves."""
    root: dict = {}

    def field(node: dict, path: str) -> dict:
        for name in path.split("."):
            node = node.setdefault("fields", {}).setdefault(name, {})
        return node

    for raw in pointers:
        p = parse_pointer(raw) if not raw.startswith("dshs#") else None
        if p is None or p.is_literal:
            continue
        node = root
        for step in p.explode:
            node = field(node, step).setdefault("element", {})
        for s in p.steps:
            if isinstance(s, int):
                node.setdefault("element", {})
                break  # what an index names is a VARIANT, walked by path
            node = field(node, s)

    def build(node: dict) -> T.DataType:
        if "fields" in node:
            return T.StructType([T.StructField(n, build(x)) for n, x in node["fields"].items()])
        return T.ArrayType(build(node["element"])) if "element" in node else T.VariantType()

    out = build(root)
    return out if isinstance(out, T.StructType) else T.StructType([])


def _misshapen(v: Column, typed: Column, dt: T.DataType) -> Column:
    """Whether some part of a VARIANT is there but not built as ``dt`` says (and so is null in ``typed``)."""
    if isinstance(dt, T.VariantType):
        return F.lit(False)
    there = F.coalesce(v.isNotNull() & ~F.is_variant_null(v), F.lit(False))
    if isinstance(dt, T.StructType):
        parts = [_misshapen(variant_value(v, (f.name,), "variant"), typed.getField(f.name), f.dataType) for f in dt.fields]
        inside = reduce(lambda a, b: a | b, parts, F.lit(False))
    else:
        each = F.zip_with(F.try_variant_get(v, "$", "array<variant>"), typed, lambda a, b: _misshapen(a, b, dt.elementType))
        inside = F.coalesce(F.exists(each, lambda x: x), F.lit(False))
    return there & (typed.isNull() | inside)


def read_variant(spark: SparkSession, path: str | list[str], pointers: list[str]) -> DataFrame:
    """Records of JSON lines with the fields that ``pointers`` need, ``BROKEN`` and ``FILE`` (see ``read_records``).

    One pass over the text. A line that is no JSON, no object, or not built as the pointers say is broken.
    """
    schema = pointer_schema(pointers)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(FILE)).filter(F.trim("value") != "")
    rows = lines.select(F.try_parse_json("value").alias("__v"), "value", FILE)
    rows = rows.withColumn("__r", F.try_variant_get("__v", "$", schema.simpleString()))
    bad = F.col("__r").isNull() | _misshapen(F.col("__v"), F.col("__r"), schema)
    return rows.select(*[F.col("__r").getField(f.name).alias(f.name) for f in schema.fields],
                       F.when(bad, F.col("value")).alias(BROKEN), FILE)


def variant_value(c: Column, steps: tuple, kind: str) -> Column:
    """The value at ``steps`` below a VARIANT as ``kind``; null where there is none or it is another type."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.try_variant_get(c, path, kind)


def unfit_values(df: DataFrame, pointers: list[str], types: dict[str, str]) -> Column:
    """Whether a record holds a value that cannot be what ``types`` says: neither absent nor null, and of another type."""
    bad = []
    for raw in dict.fromkeys(pointers):
        p = parse_pointer(raw, tuple(df.columns)) if not raw.startswith("dshs#") else None
        if p is None or p.is_literal or leaf_path(p) not in types:
            continue
        dt: T.DataType = df.schema
        c: Column | None = None
        many = False
        steps = list(p.steps)
        walk = [s for e in p.explode for s in [*e.split("."), None]]  # None: into the elements
        while steps and isinstance(steps[0], str):
            walk.append(steps.pop(0))
        for s in walk:
            if s is None:
                if many:
                    c = F.flatten(c)
                many, dt = True, dt.elementType
            else:
                c, dt = (F.col(f"`{s}`") if c is None else c.getField(s)), dt[s].dataType
        if steps and isinstance(dt, T.ArrayType):
            first, dt = F.lit(steps.pop(0)), dt.elementType
            c = F.transform(c, lambda x: F.get(x, first)) if many else F.get(c, first)
        if not isinstance(dt, T.VariantType):
            continue
        kind, rest = types[leaf_path(p)], tuple(steps)
        wrong = lambda v: F.coalesce(
            variant_value(v, rest, "variant").isNotNull() & ~F.is_variant_null(variant_value(v, rest, "variant"))
            & variant_value(v, rest, kind).isNull(), F.lit(False))
        bad.append(F.coalesce(F.exists(c, wrong), F.lit(False)) if many else wrong(c))
    return reduce(lambda a, b: a | b, bad, F.lit(False))

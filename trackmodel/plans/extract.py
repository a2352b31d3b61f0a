"""One definition of a mapping -> a lazy DataFrame of documents.

Order of steps (one Spark plan per definition, straight from the source):

1. resolve every pointer against the source schema (driver side);
2. unnest the trie of this definition's array steps;
3. when partitioned: epoch-ms timestamp and 1-based slice number (one pass, no per-slice jobs);
4. project every attribute; repeated rows collapse (a ``distinct`` for flat collections, sets inside
   the nesting aggregates otherwise, which saves a shuffle);
5. nested array: group by slice + outer + nested attributes, collect sorted tuples; an outer array
   is grouped by slice + outer attributes on its own and joined back on that key;
6. nested collection: group by slice + outer attributes, collect sorted structs (``n_id`` first);
7. ``<array>_cols`` name indexes at document level;
8. key to string, slice suffix; with ``parts``, a key of too many rows becomes several documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions import pointers as P
from trackmodel.functions.pointers import Pointer, parse_pointer
from trackmodel.operators.nest import nest_array, nest_collection, q, with_cols_index
from trackmodel.operators.parts import PART, PART_OF, PARTS, assign_parts, part_key
from trackmodel.operators.timeparts import assign_partition, normalize_ts, partition_suffix
from trackmodel.operators.unnest import pointer_column, unnest
from trackmodel.plans.mapping import Definition
from trackmodel.sources.files import FILE
from trackmodel.sources.variant import leaf_path, variant_value

BUCKET = "__bucket"
TS_MS = "__ts_ms"
DEF_COL = "__def"
REASON = "reason"
NO_KEY = "NO_KEY"
NO_TIMESTAMP = "NO_TIMESTAMP"


class _Resolver:
    def __init__(self, df: DataFrame, d: Definition, outer: bool):
        cols = tuple(df.columns)
        self.ptrs: dict[str, Pointer] = {raw: parse_pointer(raw, cols) for raw in d.pointers()}
        paths = [p.explode for p in self.ptrs.values() if not p.is_literal and p.explode]
        self.df, self.alias = unnest(df, paths, outer=outer)
        self.types = d.types

    def col(self, raw: str) -> Column:
        return _resolve(self.df, self.alias, self.ptrs[raw], self.types)


def _resolve(df: DataFrame, alias: dict, p: Pointer, types: dict[str, str]) -> Column:
    """The column of a pointer over unnested ``df``; a VARIANT becomes the type that ``types`` names, else text."""
    if p.is_literal:
        return F.lit(p.literal)
    cut = next((i + 1 for i, s in enumerate(p.steps) if isinstance(s, int)), len(p.steps))
    c = pointer_column(alias, p.explode, p.steps[:cut], p.verbatim)
    if isinstance(df.select(c.alias("_")).schema["_"].dataType, T.VariantType):
        return variant_value(c, p.steps[cut:], types.get(leaf_path(p), "string"))
    return pointer_column(alias, p.explode, p.steps, p.verbatim)


def _filler(dt: T.DataType) -> Column | None:
    """A non-null stand-in of type ``dt`` for a null group key (None for types without one)."""
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.lit("").cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast("timestamp").cast(dt)
    return None


def _null_free_keys(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]] | None:
    """Replace each group key ``k`` by ``(k__nn, k__in)`` = (value or a stand-in, is null).

    Aggregates grouped by these columns and joined on plain equality of the same columns keep null
    keys matching and let the join reuse the aggregates' hash partitioning (a null-safe join would
    re-shuffle both sides on derived expressions). None when some key has no stand-in.
    """
    fills = {k: _filler(rows.schema[k].dataType) for k in keys}
    if any(f is None for f in fills.values()):
        return None
    cols = {}
    for k, f in fills.items():
        cols[f"{k}__nn"] = F.coalesce(q(k), f)
        cols[f"{k}__in"] = q(k).isNull()
    return rows.withColumns(cols).drop(*keys), [c for k in keys for c in (f"{k}__nn", f"{k}__in")]


def _restore_keys(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.withColumns({k: F.when(F.col(f"{k}__in"), F.lit(None)).otherwise(F.col(f"{k}__nn"))
                             for k in keys}).drop(*[c for k in keys for c in (f"{k}__nn", f"{k}__in")])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        raise ValueError("documents need a group key")
    r = right.select(*[q(k).alias(f"__r_{i}") for i, k in enumerate(keys)],
                     *[q(c) for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)])
    return left.join(r, cond, "inner").drop(*[f"__r_{i}" for i in range(len(keys))])


def extract_definition(df: DataFrame, d: Definition, time_format: str = "ms", sep: str = "__",
                       outer: bool = False) -> DataFrame:
    """Documents of one definition (null keys included; see :func:`split_rejected`).

    Rows of a partitioned definition without a usable timestamp are in :func:`rejected_records`, not here.
    """
    r = _Resolver(df, d, outer)
    u = r.df
    group: list[str] = []
    if d.partition:
        u = normalize_ts(u, r.col(d.partition.ts), time_format, out=TS_MS)
        u = assign_partition(u, TS_MS, d.partition.width_ms, bucket=BUCKET, origin_ms=d.partition.origin_ms)
        u = u.filter(F.col(BUCKET).isNotNull())
        group.append(BUCKET)

    # outer literals are constants: they stay out of every group key and are added to the documents
    o = [(f"__o{i}", a) for i, a in enumerate(d.attrs)]
    o_lit = {n for n, a in o if r.ptrs[a.pointer].is_literal}
    sel = [F.col(BUCKET)] if d.partition else []
    sel += [r.col(a.pointer).alias(n) for n, a in o if n not in o_lit]
    arr = [(f"__a{i}", m) for i, m in enumerate(d.array.members)] if d.array else []
    sel += [r.col(m.pointer).alias(n) for n, m in arr]
    nested = d.nested
    nat = [(f"__n{i}", a) for i, a in enumerate(nested.attrs)] if nested else []
    nar = [(f"__b{i}", m) for i, m in enumerate(nested.array.members)] if nested and nested.array else []
    sel += [r.col(a.pointer).alias(n) for n, a in nat]
    sel += [r.col(m.pointer).alias(n) for n, m in nar]
    g_outer = group + [n for n, _ in o if n not in o_lit]
    if not g_outer:
        # only constants outside: one document per non-empty source (a keyless aggregate would also
        # answer an empty source with one empty document)
        sel.append(F.lit(0).alias("__g"))
        g_outer = ["__g"]
    rows = u.select(*sel)
    restore: list[str] = []
    if nested and arr:
        # two aggregates on the same key, joined back: group both on null-free key columns so the join
        # is a plain equi-join on their own partitioning (no extra shuffle), null keys included
        nf = _null_free_keys(rows, g_outer)
        if nf is not None:
            rows, restore, g_outer = nf[0], g_outer, nf[1]
    if d.part_rows:
        rows = assign_parts(rows, [c for c in g_outer if c != "__g"], [n for n, _ in nat] or [n for n, _ in arr], d.part_rows)
        g_outer = g_outer + [PART, PARTS]
    if not nested and not arr:
        # a flat collection: the documents are the distinct projected rows
        docs = rows.distinct()
    else:
        # repeated rows collapse inside the nesting aggregates (sets), so no separate distinct pass
        docs = None
        if nested:
            g_nested = g_outer + [n for n, _ in nat]
            names = {n: a.name for n, a in nat}
            if nested.array:
                level = nest_array(rows, g_nested, [n for n, _ in nar], "__narr", distinct=True)
                members = [n for n, _ in nat] + ["__narr"]
                names["__narr"] = nested.array.name
            else:
                level = rows
                members = [n for n, _ in nat]
            # struct fields carry the model names; n_id leads so the sort follows it
            order = sorted(members, key=lambda m: 0 if names[m] == P.NESTED_KEY else 1)
            level = level.select(*[q(c) for c in g_outer], *[q(m).alias(names[m]) for m in order])
            docs = nest_collection(level, g_outer, [names[m] for m in order], nested.name,
                                   distinct=not nested.array)
        if arr:
            adocs = nest_array(rows, g_outer, [n for n, _ in arr], d.array.name, distinct=True)
            if docs is None:
                docs = adocs
            elif restore:
                docs = _restore_keys(docs.join(adocs, g_outer, "inner"), restore)
            else:
                docs = _join_null_safe(docs, adocs, g_outer)

    out = [(F.lit(r.ptrs[a.pointer].literal) if n in o_lit else q(n)).alias(a.name) for n, a in o]
    if d.array:
        out.append(q(d.array.name))
    if nested:
        out.append(q(nested.name))
    if d.partition:
        out.append(q(BUCKET))
    if d.part_rows:
        out += [q(PART), q(PARTS)]
    docs = docs.select(*out)
    if d.array:
        docs = with_cols_index(docs, d.array.name, [m.name for m in d.array.members])
    if nested and nested.array:
        docs = with_cols_index(docs, nested.array.name, [m.name for m in nested.array.members])
    key = q(P.KEY).cast("string")
    if d.partition:
        key = partition_suffix(key, F.col(BUCKET), d.partition.interval, sep)
        docs = docs.withColumn(P.KEY, key).drop(BUCKET)
    else:
        docs = docs.withColumn(P.KEY, key)
    if d.part_rows:
        docs = docs.withColumn(PART_OF, q(P.KEY)).withColumn(P.KEY, part_key(q(P.KEY)))
    return docs


REJECT_COLUMNS = (P.KEY, REASON, "text", "file")


def rejected_records(df: DataFrame, d: Definition, time_format: str = "ms", outer: bool = False) -> DataFrame:
    """``(key, reason, text, file)`` of every record that has no key or no usable timestamp, each time it occurs.

    Only the paths of the key and the timestamp are unnested. ``text`` is the record as JSON, or the array element
    that holds the key or the timestamp. Taken from the source, before anything is made distinct or nested.
    """
    raw = {"key": next(a.pointer for a in d.attrs if a.name == P.KEY)}
    if d.partition:
        raw["ts"] = d.partition.ts
    ptrs = {k: parse_pointer(v, tuple(df.columns)) for k, v in raw.items()}
    paths = [p.explode for p in ptrs.values() if not p.is_literal and p.explode]
    rows, alias = unnest(df, paths, outer=outer)
    at = max(paths, key=len, default=())
    own = [c for c in df.columns if c != FILE]
    text = F.to_json(F.struct(alias[at]) if at else F.struct(*[q(c) for c in own]))
    if at:
        text = F.get_json_object(text, f"$.{alias[at]}")
    col = {k: _resolve(rows, alias, p, d.types) for k, p in ptrs.items()}
    reason = F.when(col["key"].isNull(), NO_KEY)
    if d.partition:
        rows = normalize_ts(rows, col["ts"], time_format, out=TS_MS)
        reason = F.when(F.col(TS_MS).isNull(), NO_TIMESTAMP).otherwise(reason)
    file = F.col(FILE) if FILE in df.columns else F.lit(None).cast("string")
    out = rows.select(col["key"].cast("string").alias(P.KEY), reason.alias(REASON), text.alias("text"), file.alias("file"))
    return out.filter(F.col(REASON).isNotNull())


def rejected_rows(df: DataFrame, defs: list[Definition], time_format: str = "ms", outer: bool = False) -> DataFrame:
    """``rejected_records`` of every definition of a collection."""
    return reduce(lambda a, b: a.unionByName(b), [rejected_records(df, d, time_format, outer) for d in defs])


def split_rejected(docs: DataFrame, key: str = P.KEY) -> tuple[DataFrame, DataFrame]:
    """(documents with a key, documents without one); the latter are reported, never imported."""
    return docs.filter(q(key).isNotNull()), docs.filter(q(key).isNull())


def union_definitions(parts: list[DataFrame], tag: bool = False) -> DataFrame:
    """Bag union of the documents of several definitions of one collection; missing fields are null.

    ``tag=True`` adds ``__def`` (definition order), used to keep one document per key on apply.
    """
    if not parts:
        raise ValueError("no definitions")
    if tag:
        parts = [p.withColumn(DEF_COL, F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def extract_collection(df: DataFrame, defs: list[Definition], time_format: str = "ms", sep: str = "__",
                       outer: bool = False, tag: bool = False) -> DataFrame:
    parts = [extract_definition(df, d, time_format, sep, outer) for d in defs]
    if tag:
        parts = [p.withColumn(DEF_COL, F.lit(d.index)) for p, d in zip(parts, defs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def feature_constants(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Stamp the scalar features of a mapping on every document."""
    return df.withColumns({k: F.lit(v) for k, v in features.items()}) if features else df

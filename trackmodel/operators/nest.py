"""Re-nesting: rows -> documents with arrays of positional tuples and arrays of structs, and back.

All nests are ``groupBy(...).agg(collect_list(...))``: Spark aggregates partially on the map side, then
merges per group. Lists are sorted so the output is deterministic. A document holds what its group key
selects; partitioned collections add the time slice to the key, which bounds the size of each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmodel.functions.columns import uniform_array


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def tuple_column(df: DataFrame, members: list[str]) -> Column:
    types = [df.schema[m].dataType for m in members]
    return uniform_array([q(m) for m in members], types)


def _collect(c: Column, distinct: bool) -> Column:
    # a set drops repeated rows inside the aggregation itself (partial sets per task), which is what a
    # `distinct` of the rows before grouping would do, without its extra shuffle
    return F.sort_array(F.collect_set(c) if distinct else F.collect_list(c))


def nest_array(df: DataFrame, group_cols: list[str], members: list[str], name: str,
               distinct: bool = False) -> DataFrame:
    """One row per group with ``name`` = sorted list of ``[m1, m2, ...]`` tuples (A2/A3)."""
    tup = tuple_column(df, members)
    return df.groupBy(*[q(c) for c in group_cols]).agg(_collect(tup, distinct).alias(name))


def nest_collection(df: DataFrame, group_cols: list[str], members: list[str], name: str,
                    distinct: bool = False) -> DataFrame:
    """One row per group with ``name`` = sorted list of structs of ``members`` (first member leads the order) (A4)."""
    st = F.struct(*[q(m) for m in members])
    return df.groupBy(*[q(c) for c in group_cols]).agg(_collect(st, distinct).alias(name))


def with_cols_index(df: DataFrame, array_name: str, members: list[str]) -> DataFrame:
    """Add ``<array_name>_cols``: the member names of the tuples, in tuple order."""
    return df.withColumn(f"{array_name}_cols", F.array(*[F.lit(m) for m in members]))


def expand_tuples(df: DataFrame, array_name: str, names: list[str] | None = None, keep: list[str] | None = None,
                  outer: bool = False) -> DataFrame:
    """Inverse of a tuple nest: one row per tuple with one column per member (A10).

    ``names`` are the member names, i.e. the ``<array_name>_cols`` index, a constant of the mapping.
    """
    if names is None:
        raise ValueError("pass the member names (the <array>_cols index of the mapping)")
    keep = keep if keep is not None else [c for c in df.columns if c not in (array_name, f"{array_name}_cols")]
    gen = F.explode_outer if outer else F.explode
    t = df.select(*[q(c) for c in keep], gen(q(array_name)).alias("__t"))
    return t.select(*[q(c) for c in keep], *[F.get(F.col("__t"), F.lit(i)).alias(n) for i, n in enumerate(names)])


def expand_collection(df: DataFrame, collection: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of a nested collection, its struct fields as columns."""
    keep = keep if keep is not None else [c for c in df.columns if c != collection]
    return df.select(*[q(c) for c in keep], F.inline(q(collection)))


def to_documents(df: DataFrame, key: str | None = "schema_identifier", name: str = "document") -> DataFrame:
    """Rows -> JSON documents; null fields are omitted at every struct level (K1)."""
    doc = F.to_json(F.struct(*[q(c) for c in df.columns])).alias(name)
    if key and key in df.columns:
        return df.select(q(key).cast("string").alias(key), doc)
    return df.select(doc)


def group_documents(df: DataFrame, attribute: str, key: str | None = "schema_identifier",
                    name: str = "document") -> DataFrame:
    """Documents grouped by one attribute, as ``(attribute, document)`` rows clustered by the attribute.

    A "map of lists" stays a DataFrame and no group is ever folded into one row. The rows are range
    partitioned on ``(attribute, key, document)``, not hashed on the attribute alone: range bounds are
    sampled from the composite key, so a group holding a third of all documents is cut across several
    tasks (adjacent partitions, still in order) instead of landing in one. Use :func:`write_grouped` for
    one folder per group.
    """
    doc = F.to_json(F.struct(*[q(c) for c in df.columns])).alias(name)
    order = [q(attribute)] + ([q(key)] if key and key in df.columns and key != attribute else [])
    out = df.select(*order, doc)
    return out.orderBy(*order, name).select(q(attribute), name)


def write_grouped(df: DataFrame, attribute: str, path: str) -> None:
    """One folder per attribute value holding that group's documents (JSON lines)."""
    group_documents(df, attribute).write.partitionBy(attribute).mode("errorifexists").json(path)

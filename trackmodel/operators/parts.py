"""Documents of very many rows, kept as several parts.

A document holds all rows of its key, and a key may hold a third of all rows (a recording under a constant key). With
``parts`` a key of more than ``rows`` rows becomes ``ceil(n / rows)`` documents; the members (nested rows, or tuples)
go to them by a hash, so each holds about ``rows`` rows however large the input is. All documents of such a definition
say which whole they are part of: ``part_of`` (the key without the part), ``part`` (from 0) and ``parts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_OF, PART, PARTS = "part_of", "part", "parts"
#: Keys with several parts that may be broadcast.
MAX_BROADCAST_KEYS = 100_000


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def assign_parts(rows: DataFrame, keys: list[str], members: list[str], part_rows: int) -> DataFrame:
    """Add ``part`` and ``parts`` to ``rows``: by a hash of ``members`` within each group of ``keys`` (none: all rows
    are one group, whose number of parts is one scalar).

    Counts combine in every task before they meet. Only keys with several parts are looked up, by broadcast where
    there are few of them, so the rows of a hot key stay where they are.
    """
    if not keys:
        parts = rows.select(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)), F.lit(1)).cast("int")).scalar()
        part = F.pmod(F.xxhash64(*[q(m) for m in members]), F.col(PARTS)).cast("int")
        return rows.withColumn(PARTS, parts).withColumn(PART, part)
    many = rows.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > part_rows)
    many = many.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                       F.ceil(F.col("__rows") / F.lit(part_rows)).cast("int").alias("__parts"))
    if many.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        many = F.broadcast(many)
    same = reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    parts = F.coalesce("__parts", F.lit(1))
    part = F.pmod(F.xxhash64(*[q(m) for m in members]), parts).cast("int")
    return rows.join(many, same, "left").withColumns({PART: part, PARTS: parts}).drop("__parts", *[f"__k{i}" for i in range(len(keys))])


def part_key(key: Column) -> Column:
    """Key of a part: the whole's, with ``__part_<i>of<n>`` when there are several."""
    return F.when(F.col(PARTS) > 1, F.format_string("%s__part_%dof%d", key, F.col(PART), F.col(PARTS))).otherwise(key)


def current_parts(docs: DataFrame, created: str = "_created") -> DataFrame:
    """``docs`` without parts of an earlier split: a key whose number of parts changed holds those made last."""
    if created not in docs.columns:
        return docs
    last = docs.groupBy(q(PART_OF).alias("__of"), q(PARTS).alias("__n")).agg(F.max(created).alias("__at"))
    last = last.groupBy("__of").agg(F.max(F.struct("__at", "__n"))["__n"].alias("__n"))
    return docs.join(last, q(PART_OF).eqNullSafe(F.col("__of")) & (q(PARTS) == F.col("__n"))).drop("__of", "__n")


def part_members(docs: DataFrame, name: str) -> DataFrame:
    """One row per member of the whole documents, ``part_of`` and ``member``: the parts united, no row grows."""
    return current_parts(docs).select(PART_OF, F.explode(q(name)).alias("member"))


def unite_parts(docs: DataFrame, name: str, key: str) -> DataFrame:
    """Whole documents again, as if they had not been split: one row per key, its members sorted.

    For documents that fit a row; :func:`part_members` is the way to read the others.
    """
    system = [f for f in ("_id", "_etag", "_created", "_updated") if f in docs.columns]
    now = current_parts(docs)
    rest = [c for c in now.columns if c not in (key, name, PART_OF, PART, PARTS, *system)]
    if isinstance(docs.schema[name].dataType, T.ArrayType) is False:
        raise ValueError(f"{name} is no array")
    out = now.groupBy(q(PART_OF).alias(key), *[q(c) for c in rest]).agg(F.sort_array(F.flatten(F.collect_list(q(name)))).alias(name))
    return out.select(*[q(c) for c in docs.columns if c in (key, name, *rest)])

"""Unnest a nested source along the array steps of a definition's pointers.

The steps of all pointers form a trie; every distinct prefix becomes one generator, so pointers that
share a prefix (``events/home.teamid`` and ``events/visitor.teamid``) unnest ``events`` once. Each
definition unnests only its own paths, straight from the source.

Sibling arrays under one parent (``lines`` and ``returns`` of one order) are unnested position-aligned
(element *i* of each, missing positions null) rather than as a Cartesian product, so the row count is
bounded by the longest sibling instead of growing with the product of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.pointers import _steps, apply_steps

Path = tuple[str, ...]


def _dtype(df: DataFrame, c: Column) -> T.DataType:
    return df.select(c.alias("_")).schema.fields[0].dataType


def explode_trie(paths: list[Path]) -> list[Path]:
    """All distinct prefixes of ``paths`` in breadth-first, first-seen order."""
    seen: dict[Path, None] = {}
    for p in paths:
        for k in range(1, len(p) + 1):
            seen.setdefault(tuple(p[:k]), None)
    return sorted(seen, key=len)


def unnest(df: DataFrame, paths: list[Path], outer: bool = False, prefix: str = "__u") -> tuple[DataFrame, dict[Path, str]]:
    """Add one column per trie node holding the current element of that array step.

    Returns the widened DataFrame and ``{path: column name}``. ``outer=False`` drops rows whose array
    is empty or null (as a plain unnest does); ``outer=True`` keeps them with a null element.
    A step whose type is a struct instead of an array (a lone repeated XML child) is one element.
    """
    nodes = explode_trie([tuple(p) for p in paths if p])
    alias: dict[Path, str] = {}
    gen = F.explode_outer if outer else F.explode
    # group the children of each parent, keeping first-seen order
    by_parent: dict[Path, list[Path]] = {}
    for n in nodes:
        by_parent.setdefault(n[:-1], []).append(n)
    counter = 0
    for depth in range(1, max((len(n) for n in nodes), default=0) + 1):
        for parent, children in by_parent.items():
            if len(parent) != depth - 1:
                continue
            base = F.col(alias[parent]) if parent else None
            arrays: list[tuple[Path, Column]] = []
            for child in children:
                expr = apply_steps(base, _steps(child[-1]))
                dt = _dtype(df, expr)
                name = f"{prefix}{counter}"
                counter += 1
                alias[child] = name
                if isinstance(dt, T.ArrayType):
                    arrays.append((child, expr))
                elif isinstance(dt, T.StructType):
                    df = df.withColumn(name, expr)
                    if not outer:  # as an empty array would: no child, no row, whatever type was inferred
                        df = df.filter(F.col(name).isNotNull())
                else:
                    raise ValueError(f"step {'/'.join(child)!r} is {dt.simpleString()}, not an array or struct")
            if len(arrays) == 1:
                child, expr = arrays[0]
                df = df.select("*", gen(expr).alias(alias[child]))
            elif len(arrays) > 1:
                n = F.greatest(*[F.size(e) for _, e in arrays])
                idx = f"{prefix}{counter}_i"
                counter += 1
                positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
                df = df.select("*", gen(positions).alias(idx))
                df = df.withColumns({alias[c]: F.get(e, F.col(idx)) for c, e in arrays})
    return df, alias


def pointer_column(alias: dict[Path, str], explode: Path, steps: tuple, verbatim: bool = False) -> Column:
    """The column a pointer names once its array steps have been unnested."""
    base = F.col(alias[tuple(explode)]) if explode else None
    if not steps:
        return base
    return apply_steps(base, tuple(steps), verbatim)


def explode_one(df: DataFrame, array_col: str, alias: str, outer: bool = False) -> DataFrame:
    """One array level: one row per element."""
    gen = F.explode_outer if outer else F.explode
    return df.select("*", gen(F.col(array_col)).alias(alias))

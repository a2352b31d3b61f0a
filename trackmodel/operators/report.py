"""Import reports: operation counts, outcomes, provenance stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmodel.functions.columns import PROVENANCE_COLUMNS
from trackmodel.operators.upsert import CREATED, UPDATED


def import_counts(plans: list[DataFrame] | DataFrame) -> DataFrame:
    """``(collection, op, n)``: how many documents each collection would create / update (R1, dry run R4).

    Repeated keys are counted once per occurrence, as a per-document check does.
    """
    plans = plans if isinstance(plans, list) else [plans]
    parts = [p.select("collection", "op") for p in plans]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy("collection", "op").agg(F.count(F.lit(1)).alias("n"))


def import_outcome(outcomes: list[DataFrame] | DataFrame) -> DataFrame:
    """``(collection, op, status, n, message)``: the grouped result of an apply (R2)."""
    outcomes = outcomes if isinstance(outcomes, list) else [outcomes]
    both = reduce(lambda a, b: a.unionByName(b), outcomes)
    g = both.groupBy("collection", "op", "status").agg(F.sum("n").alias("n"))
    msg = F.when(F.col("status") == CREATED, F.format_string("Created %d new documents", F.col("n"))) \
        .when(F.col("status") == UPDATED, F.format_string("Updated %d documents", F.col("n"))) \
        .otherwise(F.format_string("%d documents not applied: %s", F.col("n"), F.col("status")))
    return g.withColumn("message", msg)


def with_provenance(df: DataFrame, author: str, message: str, file_name: str, mapping: str, fmt: str) -> DataFrame:
    """Stamp who imported what from where (R3). The stamps are no part of a document's version tag."""
    return df.withColumns(dict(zip(PROVENANCE_COLUMNS, map(F.lit, (author, message, file_name, mapping, fmt)))))

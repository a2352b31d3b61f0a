"""Time handling: epoch-ms normalisation, bounds, fixed-width time partitions and their key suffix.

A partitioned collection is cut into slices ``[min + (k-1)*w, min + k*w)`` counted from the data minimum.
Instead of one filtered job per slice, every row gets its 1-based slice number ``k`` in a single pass and
``k`` joins every later distinct/group key, so one job handles all slices and the size of a nested
document is bounded by one slice.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.columns import MS_FORMAT, parse_interval, to_epoch_ms

TAIL_KEEP = "keep"
TAIL_DROP = "drop"


def normalize_ts(df: DataFrame, c: Column | str, fmt: str = MS_FORMAT, out: str = "ts_ms") -> DataFrame:
    """Add ``out`` = epoch ms of ``c`` (``fmt='ms'`` for epoch-ms numbers/text, else a datetime pattern)."""
    c = F.col(c) if isinstance(c, str) else c
    dtype = df.select(c.alias("_")).schema.fields[0].dataType
    return df.withColumn(out, to_epoch_ms(c, dtype, fmt))


def time_bounds(df: DataFrame, ms_col: str) -> DataFrame:
    """One row: ``min_ms``, ``max_ms`` (partial aggregation, no shuffle of rows)."""
    return df.agg(F.min(ms_col).alias("min_ms"), F.max(ms_col).alias("max_ms"))


def _floor_div(d: Column, width: int) -> Column:
    # floor of d / width for epoch-ms differences; exact for |d| < 2**52 (> 100,000 years of ms)
    return F.floor(d / F.lit(width)).cast("long")


def assign_partition(df: DataFrame, ms_col: str, width_ms: int, tail: str = TAIL_KEEP,
                     bucket: str = "__bucket", origin_ms: int | None = None) -> DataFrame:
    """Add the 1-based slice number ``bucket``; rows without a usable timestamp stay, with a null number.

    Slices count from ``origin_ms`` or, by default, from the data's minimum. The minimum (and for ``tail='drop'`` the maximum) is a scalar subquery over the same rows: Spark
    runs it once as a one-row aggregate and inlines the value, so no row is shuffled and nothing is
    collected. ``tail='drop'`` reproduces the legacy slicing loop, which emitted ``ceil(span/w)``
    slices and so lost the rows at the maximum when the span is an exact multiple of ``w``; no import uses it.
    """
    if tail not in (TAIL_KEEP, TAIL_DROP):
        raise ValueError(f"tail must be {TAIL_KEEP!r} or {TAIL_DROP!r}")
    lo = df.select(F.min(ms_col)).scalar() if origin_ms is None else F.lit(int(origin_ms)).cast("long")
    out = df.withColumn(bucket, _floor_div(F.col(ms_col) - lo, width_ms) + 1)
    if tail == TAIL_DROP:
        hi = df.select(F.max(ms_col)).scalar()
        n_slices = F.ceil((hi - lo) / F.lit(width_ms))
        out = out.filter((F.col(bucket) <= n_slices) | F.col(bucket).isNull())
    return out


def partition_count(df: DataFrame, ms_col: str, width_ms: int) -> DataFrame:
    """One row: ``n_slices`` = ``(max-min) div w + 1`` (tail kept) and ``n_slices_legacy`` =
    ``ceil((max-min)/w)`` (the legacy loop, which drops the tail); 0 for no rows."""
    b = time_bounds(df.filter(F.col(ms_col).isNotNull()), ms_col)
    span = F.col("max_ms") - F.col("min_ms")
    return b.select(F.coalesce(_floor_div(span, width_ms) + 1, F.lit(0).cast("long")).alias("n_slices"),
                    F.coalesce(F.ceil(span / F.lit(width_ms)).cast("long"), F.lit(0).cast("long")).alias("n_slices_legacy"))


def suffix_text(interval: str, sep: str = "__") -> str:
    amount, unit, _ = parse_interval(interval)
    return f"{sep}{amount}{unit}_"


def partition_suffix(key: Column, bucket: Column, interval: str, sep: str = "__") -> Column:
    """Key of a slice document: ``<key><sep><amount><unit>_<k>`` (e.g. ``1__5m_3``)."""
    return F.concat(key.cast("string"), F.lit(suffix_text(interval, sep)), bucket.cast("string"))


def time_range_filter(df: DataFrame, col: str, lo_ms: int, hi_ms: int) -> DataFrame:
    """Rows with ``lo <= time <= hi`` in epoch ms (both inclusive).

    The bounds are converted once to the type of ``col`` (epoch-ms number, or timestamp read as UTC), so the
    range is on the stored column itself and skips Parquet row groups.
    """
    dt = df.schema[col].dataType

    def bound(ms: int, extra_us: int = 0) -> Column:
        t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ms * 1000 + extra_us)
        if isinstance(dt, T.TimestampNTZType):
            return F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(t.isoformat(sep=" ")).cast("timestamp")

    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return df.filter((F.col(col) >= bound(lo_ms)) & (F.col(col) <= bound(hi_ms, 999)))
    return df.filter(F.col(col).between(lo_ms, hi_ms))

"""Column-expression helpers (all JVM-side built-ins, safe under ANSI mode)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.pointers import URLIFY_DROP, URLIFY_SPACES

# --- fixed values: interval units accepted by a partition spec (in milliseconds), the epoch-ms format
# name, and the system attributes of a stored document (the reference also has the HTTP-only `_links`) ---
UNIT_MS = {"s": 1000, "m": 60 * 1000, "h": 60 * 60 * 1000}
MS_FORMAT = "ms"
SYSTEM_COLUMNS = ("_id", "_created", "_updated", "_etag")
# --- end of fixed values ---

PROVENANCE_COLUMNS = ("import_author", "import_message", "import_file", "import_mapping", "import_format")

_INTERVAL = re.compile(r"^\s*(\d+)\s*([A-Za-z]+)\s*$")


def parse_interval(spec: str) -> tuple[int, str, int]:
    """``'5m'`` -> ``(5, 'm', 300000)``; unknown units fail at plan time."""
    m = _INTERVAL.match(str(spec))
    if not m:
        raise ValueError(f"bad interval {spec!r}: expected <int><unit> with unit in {sorted(UNIT_MS)}")
    amount, unit = int(m.group(1)), m.group(2)
    if unit not in UNIT_MS:
        raise ValueError(f"unknown interval unit {unit!r} in {spec!r}; known: {sorted(UNIT_MS)}")
    if amount <= 0:
        raise ValueError(f"interval must be positive: {spec!r}")
    return amount, unit, amount * UNIT_MS[unit]


def urlify_col(c: Column | str) -> Column:
    """The alias rule of additional fields, applied to data."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, URLIFY_DROP, ""), URLIFY_SPACES, "_")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def uniform_array(cols: list[Column], types: list[T.DataType]) -> Column:
    """A positional tuple with one element type: all-numeric members become double, otherwise every
    member becomes its string form (Spark 4 ANSI would raise on a mixed ``array(int, string)``)."""
    if types and all(is_numeric(t) for t in types):
        return F.array(*[c.cast("double") for c in cols])
    if types and all(isinstance(t, T.StringType) for t in types):
        return F.array(*cols)
    return F.array(*[c.cast("string") for c in cols])


def ntz_epoch_ms(c: Column) -> Column:
    """Epoch ms of a wall-clock (``timestamp_ntz``/``date``) value read as UTC, whatever the session time
    zone (a cast to ``timestamp`` would shift it by the session offset). Floors, like epoch_us // 1000."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    return ((us - F.pmod(us, F.lit(1000))) / F.lit(1000)).cast("long")


def to_epoch_ms(c: Column, dtype: T.DataType, fmt: str = MS_FORMAT) -> Column:
    """Normalise a timestamp-ish column to epoch milliseconds (long); unparsable values become null.

    ``fmt='ms'`` means the value already is epoch ms (number or numeric text); any other ``fmt`` is a
    datetime pattern. Timestamp-typed input is converted directly whatever ``fmt`` says.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return ntz_epoch_ms(c)
    if fmt == MS_FORMAT:
        if isinstance(dtype, T.IntegralType):
            return c.cast("long")
        return c.try_cast("decimal(20,3)").try_cast("long")
    return F.unix_millis(F.try_to_timestamp(c.cast("string"), F.lit(fmt)))


def canonical_json(cols: list[str]) -> Column:
    """JSON of the named columns in name order: independent of column order, nulls omitted."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(cols)]))


def etag_col(business_cols: list[str]) -> Column:
    """Version tag of a document: a hash of its business columns only, without the import's stamps."""
    return F.sha2(canonical_json([c for c in business_cols if c not in PROVENANCE_COLUMNS]), 256)


def doc_id_col(collection: str, key: Column) -> Column:
    """Deterministic surrogate id (24 hex chars, like an ObjectId) so re-evaluation never changes it."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(collection), key), 256), 1, 24)


def pack_hex(c: Column) -> Column:
    """Text as it is shuffled: hex digits (ids, version tags) as half as many bytes, any other text as it is."""
    hex_ = c.rlike("^([0-9a-f]{2})+$")
    return F.when(c.isNotNull(), F.struct(F.when(hex_, F.unhex(c)).alias("hex"), F.when(~hex_, c).alias("text")))


def unpack_hex(c: Column) -> Column:
    """The text that :func:`pack_hex` was given."""
    return F.coalesce(F.lower(F.hex(c["hex"])), c["text"])


def json_array(c: Column | str, element: str = "array<double>") -> Column:
    """Recover a nested array that a mixed-type JSON array turned into text (e.g. the participants
    member of a moment tuple): ``'[[1,2.5],[3,4]]'`` -> ``array<array<double>>``; bad text -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, f"array<{element}>", {"mode": "PERMISSIVE"})

"""The pointer language of a mapping: where a model attribute lives in a source.

Pointers are resolved on the driver into Column expressions; nothing here touches data.

Forms (``/`` separates array steps that are unnested, ``.`` walks struct fields, ``[i]`` takes an
array element, 0-based):

* ``name``          top-level column, taken verbatim when the source has a column of exactly that name
                    (flat feeds use names such as ``speed in m/s``)
* ``a.b.c``         struct field, no unnest
* ``a/b/c``         unnest ``a``, unnest ``b`` of its element, take ``c``
* ``a/b.c/d``       unnest ``a``, unnest the array at struct path ``b.c``, take ``d``
* ``a/m/[i]``       unnest to an inner array and take element ``i`` (null when out of range)
* literal / input   see the fixed tokens below
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the mapping language (must equal the tokens used in existing mapping documents) ---
LITERAL_PREFIX = "dshs#mapping_"
INPUT_TOKEN = "dshs#input"
KIND_FEATURE = "feature"
KIND_COLLECTION = "collection"
KIND_NESTED_COLLECTION = "nested_collection"
KIND_NESTED_ARRAY = "nested_array"
KEY = "schema_identifier"
NESTED_KEY = "n_id"
ARRAY_KEY = "a_id"
ADDITIONAL_FIELDS = "additional_fields"
PARTITION = "partition"
# alias rule of additional fields: characters removed, then whitespace runs replaced by "_"
URLIFY_DROP = r"[^\w\s]"
URLIFY_SPACES = r"\s+"
# --- end of fixed values ---

_INDEX = re.compile(r"^\[(\d+)\]$")
_NOT_WORD = re.compile(URLIFY_DROP)
_SPACES = re.compile(URLIFY_SPACES)


def urlify(name: str) -> str:
    """Alias rule for additional fields: drop every char that is neither a word char nor whitespace,
    then turn whitespace runs into ``_`` (``speed in m/s`` -> ``speed_in_ms``)."""
    return _SPACES.sub("_", _NOT_WORD.sub("", name))


@dataclass(frozen=True)
class Pointer:
    """A parsed pointer.

    ``explode`` holds the array steps to unnest, each a dotted struct path relative to the element of
    the step before; ``steps`` is what is taken from the last element (names and int indexes).
    """

    raw: str
    kind: str  # "path" | "literal"
    literal: str | None = None
    explode: tuple[str, ...] = ()
    steps: tuple[str | int, ...] = field(default_factory=tuple)
    verbatim: bool = False  # the whole pointer is one top-level column name

    @property
    def is_literal(self) -> bool:
        return self.kind == "literal"


def is_input(raw: str) -> bool:
    return raw == INPUT_TOKEN


def literal_of(raw: str) -> str | None:
    return raw[len(LITERAL_PREFIX):] if raw.startswith(LITERAL_PREFIX) else None


def _steps(text: str) -> tuple[str | int, ...]:
    out: list[str | int] = []
    for part in text.split("."):
        if part == "":
            raise ValueError(f"empty step in pointer part {text!r}")
        m = _INDEX.match(part)
        out.append(int(m.group(1)) if m else part)
    return tuple(out)


def parse_pointer(raw: str, columns: tuple[str, ...] | list[str] = ()) -> Pointer:
    """Parse ``raw`` against the top-level column names of the source."""
    if not isinstance(raw, str):
        raise TypeError(f"pointer must be a string, got {raw!r}")
    lit = literal_of(raw)
    if lit is not None:
        return Pointer(raw, "literal", literal=lit)
    if is_input(raw):
        raise ValueError(f"pointer {raw!r} needs a value from `inputs`")
    if raw in columns:
        return Pointer(raw, "path", steps=(raw,), verbatim=True)
    parts = raw.split("/")
    if any(p == "" for p in parts):
        raise ValueError(f"empty segment in pointer {raw!r}")
    for seg in parts[:-1]:
        if any(isinstance(s, int) for s in _steps(seg)):
            raise ValueError(f"index steps may only appear after the last '/' in {raw!r}")
    return Pointer(raw, "path", explode=tuple(parts[:-1]), steps=_steps(parts[-1]))


def apply_steps(base: Column | None, steps: tuple[str | int, ...], verbatim: bool = False) -> Column:
    """Walk struct fields / array indexes from ``base`` (or from the top-level columns when ``base`` is None)."""
    if verbatim:
        return F.col(f"`{steps[0]}`")
    col = base
    for s in steps:
        if isinstance(s, int):
            if col is None:
                raise ValueError("a pointer cannot start with an index")
            col = F.get(col, F.lit(s))
        elif col is None:
            col = F.col(f"`{s}`")
        else:
            col = col.getField(s)
    return col

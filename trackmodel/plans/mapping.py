"""Mapping documents -> validated definition specs (driver side, no data touched).

A mapping is ``{name, file: {format, delimiter?, header?, rowTag?, valueTag?, timestamp_format},
data: {collection: [definition, ...] | definition}}``. Everything that can be wrong with a mapping
(missing inputs, unknown units or formats, unsupported nesting) fails here, before any Spark work.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from trackmodel.functions import pointers as P
from trackmodel.functions.columns import MS_FORMAT, parse_interval

# --- fixed values: source formats a mapping may name ---
FORMATS = ("csv", "json", "xml")
# --- end of fixed values ---

#: Setting of a definition that splits documents of very many rows: ``"parts": {"rows": 50000}``.
PARTS = "parts"

#: Types a mapping may give a leaf of its source.
LEAF_TYPES = ("string", "long", "double", "boolean", "array<double>", "array<array<double>>")


@dataclass
class Attr:
    name: str
    pointer: str  # raw pointer; an input is replaced by a literal pointer when parsed


@dataclass
class ArraySpec:
    name: str
    members: list[Attr]


@dataclass
class NestedSpec:
    name: str
    attrs: list[Attr]
    array: ArraySpec | None = None


@dataclass
class Partition:
    interval: str
    ts: str
    width_ms: int
    origin_ms: int | None = None  # slices count from here; None: from the data's minimum


@dataclass
class Definition:
    collection: str
    index: int
    attrs: list[Attr]
    array: ArraySpec | None = None
    nested: NestedSpec | None = None
    partition: Partition | None = None
    types: dict[str, str] = field(default_factory=dict)  # of the mapping's file: leaf path -> type
    part_rows: int | None = None  # rows of one key beyond which its document is split into parts

    def pointers(self) -> list[str]:
        out = [a.pointer for a in self.attrs]
        if self.array:
            out += [m.pointer for m in self.array.members]
        if self.nested:
            out += [a.pointer for a in self.nested.attrs]
            if self.nested.array:
                out += [m.pointer for m in self.nested.array.members]
        if self.partition:
            out.append(self.partition.ts)
        return out


@dataclass
class FileSpec:
    format: str
    delimiter: str = ","
    header: bool = True
    row_tag: str | None = None
    value_tag: str | None = None
    timestamp_format: str = MS_FORMAT
    types: dict[str, str] = field(default_factory=dict)  # leaf path -> type, in place of what the values suggest
    variant: bool = False  # JSON lines read as VARIANT: no inference, mixed arrays keep their types


@dataclass
class Mapping:
    name: str
    file: FileSpec
    collections: dict[str, list[Definition]] = field(default_factory=dict)
    features: dict[str, str] = field(default_factory=dict)

    def definitions(self) -> list[Definition]:
        return [d for defs in self.collections.values() for d in defs]


def _truthy(v) -> bool:
    if isinstance(v, bool):
        return v
    return str(v).strip().lower() in ("true", "1", "yes")


def _leaf_types(types: dict) -> dict[str, str]:
    unknown = sorted(f"{p}: {t}" for p, t in types.items() if t not in LEAF_TYPES)
    if unknown:
        raise ValueError(f"unknown leaf types {unknown}; known: {LEAF_TYPES}")
    return dict(types)


def parse_file_spec(spec: dict) -> FileSpec:
    fmt = str(spec.get("format", "")).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown source format {spec.get('format')!r}; known: {FORMATS}")
    if fmt == "xml" and not spec.get("rowTag"):
        raise ValueError("an xml source needs file.rowTag")
    if fmt != "json" and _truthy(spec.get("variant", False)):
        raise ValueError("only a json source can be read as variant")
    return FileSpec(
        format=fmt,
        delimiter=spec.get("delimiter", ","),
        header=_truthy(spec.get("header", True)),
        row_tag=spec.get("rowTag"),
        value_tag=spec.get("valueTag"),
        timestamp_format=spec.get("timestamp_format", MS_FORMAT),
        types=_leaf_types(spec.get("types", {})),
        variant=_truthy(spec.get("variant", False)),
    )


class _Inputs:
    def __init__(self, inputs: dict | None):
        self.inputs = dict(inputs or {})
        self.missing: list[str] = []

    def resolve(self, collection: str, attribute: str | None, raw: str) -> str:
        """Replace an input token by a literal pointer carrying the user's value.

        Answers are looked up as ``<collection>#<attribute>``, then ``<attribute>``; a feature's answer
        is keyed by the feature name.
        """
        if not isinstance(raw, str) or not P.is_input(raw):
            return raw
        keys = (collection,) if attribute is None else (f"{collection}#{attribute}", attribute)
        for k in keys:
            if k in self.inputs and self.inputs[k] is not None:
                return P.LITERAL_PREFIX + str(self.inputs[k])
        self.missing.append(collection if attribute is None else f"{collection}#{attribute}")
        return raw


def _is_parts(name: str, body) -> bool:
    """A ``parts`` setting, not a nested definition of that name."""
    return name == PARTS and isinstance(body, dict) and "a" not in body


def _attrs(body: dict, collection: str, inputs: _Inputs, skip=()) -> tuple[list[Attr], dict[str, dict]]:
    attrs: list[Attr] = []
    dicts: dict[str, dict] = {}
    for k, v in body.items():
        if k in ("a", P.PARTITION) or k in skip or _is_parts(k, v):
            continue
        if k == P.ADDITIONAL_FIELDS:
            if not isinstance(v, list):
                raise ValueError(f"{collection}: additional_fields must be a list")
            for ptr in v:
                attrs.append(Attr(P.urlify(ptr), inputs.resolve(collection, P.urlify(ptr), ptr)))
        elif isinstance(v, dict):
            dicts[k] = v
        elif isinstance(v, str):
            attrs.append(Attr(k, inputs.resolve(collection, k, v)))
        else:
            raise ValueError(f"{collection}.{k}: pointer must be a string, got {v!r}")
    return attrs, dicts


def _array(name: str, body: dict, collection: str, inputs: _Inputs) -> ArraySpec:
    members, dicts = _attrs(body, collection, inputs)
    if dicts:
        raise ValueError(f"{collection}.{name}: a nested array cannot contain {sorted(dicts)}")
    if not members:
        raise ValueError(f"{collection}.{name}: a nested array needs members")
    return ArraySpec(name, members)


def parse_definition(collection: str, body: dict, index: int = 0, inputs: dict | _Inputs | None = None) -> Definition:
    inp = inputs if isinstance(inputs, _Inputs) else _Inputs(inputs)
    if body.get("a") != P.KIND_COLLECTION:
        raise ValueError(f"{collection}: definition kind must be {P.KIND_COLLECTION!r}, got {body.get('a')!r}")
    attrs, dicts = _attrs(body, collection, inp)
    if P.KEY not in {a.name for a in attrs}:
        raise ValueError(f"{collection}: a collection needs {P.KEY!r}")
    d = Definition(collection, index, attrs)
    for name, sub in dicts.items():
        kind = sub.get("a")
        if kind == P.KIND_NESTED_ARRAY:
            if d.array:
                raise ValueError(f"{collection}: only one nested array per level")
            d.array = _array(name, sub, collection, inp)
        elif kind == P.KIND_NESTED_COLLECTION:
            if d.nested:
                raise ValueError(f"{collection}: only one nested collection per definition")
            n_attrs, n_dicts = _attrs(sub, f"{collection}.{name}", inp)
            if P.NESTED_KEY not in {a.name for a in n_attrs}:
                raise ValueError(f"{collection}.{name}: a nested collection needs {P.NESTED_KEY!r}")
            spec = NestedSpec(name, n_attrs)
            for an, ab in n_dicts.items():
                if ab.get("a") != P.KIND_NESTED_ARRAY or spec.array:
                    raise ValueError(f"{collection}.{name}.{an}: only one nested array may sit in a nested collection")
                spec.array = _array(an, ab, f"{collection}.{name}", inp)
            d.nested = spec
        else:
            raise ValueError(f"{collection}.{name}: unknown definition kind {kind!r}")
    part = body.get(P.PARTITION)
    if part is not None:
        _, _, width = parse_interval(part["interval"])
        d.partition = Partition(part["interval"], part["ts_field"], width, part.get("origin_ms"))
    if _is_parts(PARTS, body.get(PARTS)):
        rows = body[PARTS].get("rows")
        if not isinstance(rows, int) or rows < 1:
            raise ValueError(f"{collection}: parts.rows must be a positive number, got {rows!r}")
        if bool(d.nested) == bool(d.array):
            raise ValueError(f"{collection}: parts need one nested collection or one nested array")
        d.part_rows = rows
    return d


def parse_mapping(mapping: dict | str, inputs: dict | None = None) -> Mapping:
    """Validate a mapping document; missing inputs are reported all at once."""
    if isinstance(mapping, str):
        mapping = json.loads(mapping)
    inp = _Inputs(inputs)
    m = Mapping(mapping.get("name", ""), parse_file_spec(mapping.get("file", {})))
    index = 0
    for name, body in mapping.get("data", {}).items():
        bodies = body if isinstance(body, list) else [body]  # older shape: one definition dict
        for b in bodies:
            kind = b.get("a")
            if kind == P.KIND_FEATURE:
                raw = inp.resolve(name, None, b.get("value"))
                lit = P.literal_of(raw) if isinstance(raw, str) else None
                m.features[name] = lit if lit is not None else raw
            elif kind == P.KIND_COLLECTION:
                m.collections.setdefault(name, []).append(parse_definition(name, b, index, inp))
                index += 1
            else:
                raise ValueError(f"{name}: unknown definition kind {kind!r}")
    for d in m.definitions():
        d.types = m.file.types
    if inp.missing:
        raise ValueError(f"missing inputs: {', '.join(inp.missing)}")
    return m

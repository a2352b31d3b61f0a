"""End to end: provider file + mapping -> documents -> staged upsert plan -> applied store versions.

``plan_import`` is the dry run (validate): it parses the source once, builds every collection's documents and plan,
writes the plans to a staging folder in the shared checkpoint area (so lineage is cut and the confirm
step reads exactly what was validated) and reports counts. ``apply_import`` (confirm) applies the
staged plans against the *current* store versions with etag checks and writes new versions. Collections do not
depend on each other, so both steps handle them at once; counts are taken while the plans and versions are written.

Every record of a source ends in documents or in one reject with its reason, text and file: records that do not
parse are rejected once per source (collection ``SOURCE``), records without a key or a usable timestamp once per
definition that wanted one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.operators.report import import_counts, import_outcome, with_provenance
from trackmodel.operators.upsert import (DEF_COL, OP_REJECT, REJECTED, apply_counted, grow_arrays, observe_plan, plan_creates,
                                         plan_upsert)
from trackmodel.plans.extract import REASON, extract_collection, feature_constants, rejected_rows, split_rejected
from trackmodel.plans.mapping import Definition, Mapping, parse_mapping
from trackmodel.functions.pointers import KEY, parse_pointer
from trackmodel.session import COMPRESSION, delete, freed_shuffles, scratch_path, stored_bytes, together
from trackmodel.sources.files import BROKEN, FILE, read_records, split_broken, whole
from trackmodel.sources.store import CollectionStore, VersionConflict, business_columns
from trackmodel.sources.typed import leaf_types, retype, text_leaves
from trackmodel.sources.variant import read_variant, unfit_values

#: The name under which rejects of the source itself are reported, beside the collections.
SOURCE = "(source)"
MALFORMED = "MALFORMED"
BAD_VALUE = "BAD_VALUE"
#: Staged bytes of a source, or of a collection's plan, from which on collections are handled one by one.
TOGETHER_BYTES = 128 * 1024 * 1024


@dataclass
class ImportPlan:
    mapping: Mapping
    documents: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, DataFrame] = field(default_factory=dict)
    plans: dict[str, DataFrame] = field(default_factory=dict)
    stage_dir: str | None = None
    planned: dict[str, dict[str, int]] = field(default_factory=dict)  # plan rows by op
    left_out: dict[str, int] = field(default_factory=dict)  # rejects
    unique: dict[str, bool] = field(default_factory=dict)  # whether a plan can hold a key once only
    base: dict[str, int | None] = field(default_factory=dict)  # the version a plan was made against

    def counts(self) -> DataFrame:
        return import_counts(list(self.plans.values()))

    def rejects(self) -> DataFrame:
        """``collection, schema_identifier, reason, text, file``: a row for each record that was left out."""
        return reduce(lambda a, b: a.unionByName(b), [r.withColumn("collection", F.lit(c)) for c, r in self.rejected.items()])

    def rejected_counts(self) -> DataFrame:
        """``(collection, reason, n)``: how many records were left out, each time they occur."""
        return self.rejects().groupBy("collection", "reason").agg(F.count(F.lit(1)).alias("n"))


def extract_documents(source: DataFrame, mapping: Mapping, sep: str = "__", outer: bool = False,
                      tag: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Documents, and rejects ``(key, reason, text, file)``, per collection, all lazy."""
    docs, rejects = {}, {}
    for collection, defs in mapping.collections.items():
        d = extract_collection(source, defs, mapping.file.timestamp_format, sep, outer, tag=tag)
        rejects[collection] = rejected_rows(source, defs, mapping.file.timestamp_format, outer)
        docs[collection], _ = split_rejected(feature_constants(d, mapping.features))
    return docs, rejects


def key_leaves(mapping: Mapping, columns: list[str]) -> set[str]:
    """Leaf paths that document keys are taken from."""
    out = set()
    for d in mapping.definitions():
        p = parse_pointer(next(a.pointer for a in d.attrs if a.name == KEY), tuple(columns))
        if not p.is_literal:
            out.add(".".join([*p.explode, *[s for s in p.steps if isinstance(s, str)]]))
    return out


def unique_keys(defs: list[Definition], source: DataFrame) -> bool:
    """Whether no two documents of a collection can have the same key: one definition, which groups by nothing but a
    key whose text form tells its values apart."""
    ptrs = [(a.name, parse_pointer(a.pointer, tuple(source.columns))) for a in defs[0].attrs]
    grouped = [n for n, p in ptrs if not p.is_literal]
    if len(defs) > 1 or defs[0].part_rows or grouped not in ([], [KEY]):
        return False
    p = next(p for n, p in ptrs if n == KEY)
    if p.is_literal:
        return True
    dt: T.DataType = source.schema
    for s in [*[s for e in p.explode for s in e.split(".")], *p.steps]:
        while isinstance(dt, T.ArrayType):
            dt = dt.elementType
        if isinstance(s, str) and isinstance(dt, T.StructType) and s in dt.names:
            dt = dt[s].dataType
    return isinstance(dt, (T.StringType, T.IntegralType))


def stage_documents(docs: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """Write extracted documents to the shared folder and read them back (lineage cut, computed once).

    ``spark``: the session to read them in (a micro-batch has one of its own; counts that are observed while
    something is written are reported to the session of its frames alone).
    """
    with freed_shuffles(docs.sparkSession):
        docs.write.mode("errorifexists").option("compression", COMPRESSION).parquet(path)
    # the schema is the one just written: reading it back needs no footer-inference job
    return (spark or docs.sparkSession).read.schema(docs.schema).parquet(path)


def stage_plan(plan: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """Write a plan to the shared folder (partitioned by ``op``) and read it back: the confirm step then
    applies exactly what was validated, and the lineage of the extraction is cut (K5)."""
    with freed_shuffles(plan.sparkSession):
        plan.write.mode("errorifexists").option("compression", COMPRESSION).partitionBy("op").parquet(path)
    return (spark or plan.sparkSession).read.schema(plan.schema).parquet(path)


def open_records(spark: SparkSession, m: Mapping, records: DataFrame, stage_dir: str, stage_source: bool = True,
                 infer_types: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, its rejects ``(key, reason, text, file)``) from :func:`trackmodel.sources.files.read_records`.

    ``infer_types``: text leaves take the type of their values (default: of XML, and of CSV whose broken lines may
    have spoilt Spark's own inference). Keys stay text; ``types`` of the mapping's ``file`` block come first, and a
    record with a value that such a type cannot hold is rejected.
    """
    seen = Observation()
    if stage_source:
        counted = records.observe(seen, F.count(F.when(F.col(BROKEN).isNotNull(), 1)).alias("broken"))
        records = stage_documents(counted, f"{stage_dir}/__source", spark)
    else:
        records = whole(records)
    good, broken = split_broken(records)
    left_out = broken.select(F.lit(None).cast("string").alias(KEY), F.lit(MALFORMED).alias(REASON), "text", "file")
    if infer_types is None:
        spoilt = seen.get["broken"] if stage_source else broken.limit(1).count()
        infer_types = m.file.format == "xml" or (m.file.format == "csv" and spoilt > 0)
    types = {} if m.file.variant else {p: T._parse_datatype_string(t) for p, t in m.file.types.items()}
    if m.file.variant and m.file.types:
        unfit = unfit_values(good, [p for d in m.definitions() for p in d.pointers()], m.file.types)
        left_out = left_out.unionByName(_bad_values(good, unfit))
        good = good.filter(~unfit)
    if infer_types:
        leaves = [p for p in text_leaves(good.drop(FILE).schema) if p not in types and p not in key_leaves(m, good.columns)]
        types |= leaf_types(good, leaves)
    types = {p: t for p, t in types.items() if p != FILE}
    if types:
        asked = {p: t for p, t in types.items() if p in m.file.types}
        fit = good
        if asked:  # a type that was found from the values holds them all
            unfit = retype(good, asked)[1]
            left_out = left_out.unionByName(_bad_values(good, unfit))
            fit = good.filter(~unfit)
        # written again with its types: every definition then reads only the fields it needs
        good = stage_documents(retype(fit, types)[0], f"{stage_dir}/__typed", spark)
    return good, left_out


def _bad_values(records: DataFrame, unfit: Column) -> DataFrame:
    own = [F.col(f"`{c}`") for c in records.columns if c != FILE]
    return records.filter(unfit).select(F.lit(None).cast("string").alias(KEY), F.lit(BAD_VALUE).alias(REASON),
                                        F.to_json(F.struct(*own)).alias("text"), F.col(FILE).alias("file"))


def plan_import(spark: SparkSession, mapping: dict | Mapping, source: str | DataFrame, store: CollectionStore,
                inputs: dict | None = None, stage_dir: str | None = None, provenance: dict | None = None,
                sep: str = "__", outer: bool = False, stage_source: bool = True, schema=None,
                sampling_ratio: float | None = None, multi_line: bool = False, grow_slices: bool = False,
                infer_types: bool | None = None) -> ImportPlan:
    """Validate an import: documents and upsert plan per collection, staged under ``stage_dir``.

    A provider file is parsed once into Parquet in the staging folder; every definition then reads only the columns
    it needs from it instead of parsing the whole text again, and a lost executor re-reads Parquet, not the text.
    ``stage_source=False`` parses it in every pass, with the same result. ``schema`` is taken as given: only the
    mapping's ``types`` change it then, unless ``infer_types`` says so.
    ``grow_slices``: nested arrays of a partitioned definition are added to those of a stored slice instead of
    replacing them whole.
    """
    m = mapping if isinstance(mapping, Mapping) else parse_mapping(mapping, inputs)
    stage_dir = stage_dir or scratch_path(spark, f"staged-{m.name or 'import'}")
    df, left_out = source, []
    if not isinstance(source, DataFrame):
        if m.file.variant:
            df = read_variant(spark, source, [p for d in m.definitions() for p in d.pointers()])
        else:
            df = read_records(spark, m.file, source, schema, sampling_ratio, multi_line)
        infer_types = False if infer_types is None and (m.file.variant or schema is not None) else infer_types
    if BROKEN in df.columns:
        df, own = open_records(spark, m, df, stage_dir, stage_source, infer_types)
        left_out.append(own.withColumn("collection", F.lit(SOURCE)))
    docs, rejects = extract_documents(df, m, sep, outer)
    left_out += [r.withColumn("collection", F.lit(c)) for c, r in rejects.items()]
    ip = ImportPlan(m, stage_dir=stage_dir)

    def rejected() -> tuple[DataFrame, dict[str, int]]:
        seen, names = Observation(), [SOURCE, *docs]
        rows = reduce(lambda a, b: a.unionByName(b), left_out).observe(
            seen, *[F.count(F.when(F.col("collection") == c, 1)).alias(f"n{i}") for i, c in enumerate(names)])
        return stage_documents(rows, f"{stage_dir}/__rejected", spark), {c: seen.get.get(f"n{i}", 0) for i, c in enumerate(names)}

    def documents(collection: str, d: DataFrame) -> tuple[DataFrame, int | None, set[str]]:
        if provenance:
            d = with_provenance(d, **provenance)
        base = store.current_version(collection)
        if base is None:
            return d, base, set()
        # the documents are computed once: a plan against a stored version reads them twice (keys, then rows)
        seen, names = Observation(), business_columns(d)
        d = d.observe(seen, *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(names)])
        d = stage_documents(d, f"{stage_dir}/{collection}__documents", spark)
        return d, base, {c for i, c in enumerate(names) if seen.get.get(f"n{i}") == 0}

    def planned(collection: str, d: DataFrame, base: int | None, filled: set[str]) -> tuple[DataFrame, dict[str, int]]:
        if base is None:
            # nothing stored yet: every document is a CREATE and the plan needs no join
            plan = plan_creates(d, collection)
        else:
            stored = store.scan(collection, version=base)
            plan = plan_upsert(d, stored, collection, filled=filled)
            growing = [x for x in m.collections[collection] if grow_slices and x.partition and (x.nested or x.array)]
            for i, x in enumerate(growing):
                arrays = [(x.array.name, None)] if x.array else []
                arrays += [(x.nested.name, x.nested.array.name if x.nested.array else None)] if x.nested else []
                plan = stage_documents(plan, f"{stage_dir}/{collection}__growing/{i}", spark)
                plan = grow_arrays(plan, stored, arrays, F.col(DEF_COL) == x.index)
        plan, seen = observe_plan(plan)
        return stage_plan(plan, f"{stage_dir}/{collection}", spark), seen.get

    limit = at_once(spark, [f"{stage_dir}/{name}" for name in ("__typed", "__source")])
    tasks: list[Callable] = [lambda c=c, d=d: documents(c, d) for c, d in docs.items()]
    *made, (rows, ip.left_out) = together(spark, [*tasks, rejected], limit)
    for c, (d, base, _) in zip(docs, made):
        ip.documents[c], ip.base[c] = d, base
    if None not in ip.base.values():  # all documents and rejects are staged
        delete_source(spark, stage_dir)
    made = together(spark, [lambda c=c, m=m: planned(c, *m) for c, m in zip(docs, made)], limit)
    for c, (plan, counts) in zip(docs, made):
        ip.plans[c], ip.planned[c] = plan, counts
    ip.rejected = {c: rows.filter(F.col("collection") == c).drop("collection") for c in ip.left_out}
    ip.unique = {c: unique_keys(defs, df) for c, defs in m.collections.items()}
    return ip


def at_once(spark: SparkSession, paths: list[str]) -> int:
    """How many collections to handle together: one by one where a staged folder is large, for then each of them keeps
    the cluster busy, and what they shuffle need not be on disk at the same time."""
    return 1 if any(stored_bytes(spark, p) > TOGETHER_BYTES for p in paths) else 8


def delete_source(spark: SparkSession, stage_dir: str) -> None:
    for name in ("__source", "__typed"):
        delete(spark, f"{stage_dir}/{name}")


def apply_import(spark: SparkSession, ip: ImportPlan, store: CollectionStore, now: Column | None = None) -> DataFrame:
    """Apply staged plans and write one new version per collection; returns the grouped outcome.

    Each version claims the number after the one it was made from; when another writer was faster, the plan
    is applied again to the newer version, where documents changed meanwhile come out as ``CONFLICT``.
    The staged source and documents are deleted first: applying reads the plans alone. The outcome (with what was
    rejected before planning, as ``REJECTED``) is stored and read back. The plans and rejects stay, as the record of
    what was done. When a collection fails the others are stopped; versions that were written stay, and the import can
    be applied again.
    """
    now = now if now is not None else F.current_timestamp()
    delete_source(spark, ip.stage_dir)
    for name in [f"{c}__{part}" for c in ip.plans for part in ("documents", "growing")]:
        delete(spark, f"{ip.stage_dir}/{name}")

    def apply(collection: str, plan: DataFrame) -> list[tuple[str, str, int]]:
        while True:
            base = store.current_version(collection)
            version, outcome = apply_counted(plan, ip.planned[collection], store.scan(collection, version=base), collection,
                                             now, unique=ip.unique.get(collection, False),
                                             same_base=base is not None and ip.base.get(collection) == base)
            try:
                store.write_version(collection, version, base or 0)
                return outcome()
            except VersionConflict:
                if store.current_version(collection) == base:
                    raise  # claimed by a writer that has not finished

    limit = at_once(spark, [f"{ip.stage_dir}/{c}" for c in ip.plans])
    done = together(spark, [lambda c=c, p=p: apply(c, p) for c, p in ip.plans.items()], limit)
    rows = [(c, op, status, n) for c, out in zip(ip.plans, done) for op, status, n in out]
    rows += [(c, OP_REJECT, REJECTED, n) for c, n in ip.left_out.items() if n]
    grouped = spark.createDataFrame(rows, "collection string, op string, status string, n long").coalesce(1)
    return stage_documents(import_outcome(grouped), f"{ip.stage_dir}/__outcome", spark)


def ingest(spark: SparkSession, mapping: dict | Mapping, source: str | DataFrame, store: CollectionStore,
           inputs: dict | None = None, **kw) -> tuple[ImportPlan, DataFrame]:
    """Validate then apply in one call; returns the plan (with counts) and the grouped outcome."""
    ip = plan_import(spark, mapping, source, store, inputs, **kw)
    return ip, apply_import(spark, ip, store)

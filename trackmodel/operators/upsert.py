"""Keyed upsert of documents into a collection: classify, merge, apply with etag checks, replace, delete.

Plan/apply contract
-------------------
* **plan**: incoming documents left-joined to the store version they were planned against. Only store
  rows whose key is in the batch take part (a left-semi join on the batch's keys, which AQE broadcasts
  when the key set is small, so the store is streamed once and not shuffled). Each plan row carries
  ``op`` (CREATE/UPDATE), the merged business columns, and the ``_etag``/``_id`` it was planned against.
* **merge**: incoming wins; structs merge field by field (recursively); arrays and scalars are replaced
  whole; a null incoming value counts as absent. Both sides are first rebuilt to their common type: a
  struct gains fields, numbers widen, nothing is ever turned into text. A widening that could change values (long
  to double) is checked on the stored column first; where it would, the stored type holds and incoming values
  that do not fit it are rejected. A document outside the batch never changes value or etag.
* **apply** re-joins the plan to the *current* version: same etag -> merged row (new ``_etag`` and
  ``_updated`` only if the content changed, so re-running an import is idempotent); other etag, or a
  CREATE whose key appeared meanwhile -> ``CONFLICT`` and the stored row stays; an UPDATE whose
  document vanished -> ``CONFLICT``. Against the very version that the plan was made for, every update meets its
  document; the plan then holds all that the new one is made from, and only keys are joined. Untouched rows are copied through. A key planned twice (one
  batch, several definitions) is applied once: the first by (definition order, SHA-256 of the canonical JSON); the
  others get ``DUPLICATE``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.columns import canonical_json, doc_id_col, etag_col, pack_hex, unpack_hex
from trackmodel.functions.pointers import KEY
from trackmodel.functions.types import common_type, conform, exact, lossy, overlay, same_type
from trackmodel.session import COMPRESSION, freed_shuffles, scratch_path
from trackmodel.sources.store import business_columns

# --- fixed values: plan operations and apply outcomes ---
OP_CREATE = "CREATE"
OP_UPDATE = "UPDATE"
OP_REJECT = "REJECT"
CREATED = "CREATED"
UPDATED = "UPDATED"
CONFLICT = "CONFLICT"
DUPLICATE = "DUPLICATE"
REPLACED = "REPLACED"
EXISTS = "EXISTS"
NO_KEY = "NO_KEY"
REJECTED = "REJECTED"
# --- end of fixed values ---

DEF_COL = "__def"
PLAN_ETAG = "__plan_etag"
PLAN_ID = "__plan_id"
PLAN_CREATED = "__plan_created"
PLAN_UPDATED = "__plan_updated"


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def settle(stored: DataFrame, old_types: dict[str, T.DataType], new_types: dict[str, T.DataType]) -> dict[str, T.DataType]:
    """The type each column of both sides is rebuilt to.

    Widenings that are exact by their types alone cost nothing. The others are tried on the stored columns in one
    aggregate over just these columns; a column that would lose a value keeps its stored types.
    """
    out = {c: common_type(old_types[c], nt) for c, nt in new_types.items() if c in old_types}
    doubt = [c for c, dt in out.items() if not exact(old_types[c], dt)]
    if doubt:
        lost = stored.agg(*[F.coalesce(F.max(lossy(q(c), old_types[c], out[c])), F.lit(False)).alias(f"c{i}")
                            for i, c in enumerate(doubt)]).first()  # one row
        out.update({c: common_type(old_types[c], new_types[c], strict=True) for c, x in zip(doubt, lost) if x})
    return out


def merge_columns(new_types: dict[str, T.DataType], old_types: dict[str, T.DataType],
                  new_col, old_col, targets: dict[str, T.DataType] | None = None, filled: Collection[str] = ()) -> list[Column]:
    """Merged business columns (union of both sides' names); ``new_col(name)``/``old_col(name)`` give the inputs.

    Columns both sides have are rebuilt to their type in ``targets`` (:func:`settle`; default: the common type that
    needs no check of values) first. ``filled``: columns without a null on the new side, which need nothing of the old
    one unless they are structs or are rebuilt.
    """
    out = []
    for c, nt in new_types.items():
        if c in old_types:
            dt = targets[c] if targets else common_type(old_types[c], nt, strict=True)
            if c in filled and same_type(nt, dt) and not isinstance(dt, T.StructType):
                out.append(new_col(c).alias(c))
                continue
            out.append(overlay(conform(new_col(c), nt, dt), conform(old_col(c), old_types[c], dt), dt).alias(c))
        else:
            out.append(new_col(c).alias(c))
    for c, ot in old_types.items():
        if c not in new_types:
            out.append(old_col(c).alias(c))
    return out


def _choose(cond: Column, new: Column, nt: T.DataType, old: Column, ot: T.DataType, dt: T.DataType) -> Column:
    """``new`` where ``cond`` holds, else ``old``, both rebuilt to ``dt``."""
    return F.when(cond, conform(new, nt, dt)).otherwise(conform(old, ot, dt))


def _unfit(new_types: dict[str, T.DataType], targets: dict[str, T.DataType], new_col) -> Column:
    """Whether some incoming value does not fit the type that its column settles on."""
    parts = [lossy(new_col(c), nt, targets[c]) for c, nt in new_types.items() if c in targets]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _types(df: DataFrame, cols: list[str]) -> dict[str, T.DataType]:
    return {c: df.schema[c].dataType for c in cols}


def plan_upsert(incoming: DataFrame, existing: DataFrame, collection: str, key: str = KEY,
                filled: Collection[str] = ()) -> DataFrame:
    """Classify every incoming document CREATE/UPDATE against ``existing`` and merge.

    ``filled``: columns of ``incoming`` known to hold no null; stored values that they replace are not shuffled. A document with a value that does not fit the stored type of its column is ``REJECT``: applying the
    plan reports it and leaves the stored document as it is.
    """
    nb = business_columns(incoming)
    ob = business_columns(existing)
    keys = incoming.select(q(key).alias("__k")).distinct()
    times = [(c, n) for c, n in (("_created", PLAN_CREATED), ("_updated", PLAN_UPDATED)) if c in existing.columns]
    old = existing.select(q(key).alias("__ok"), pack_hex(F.col("_id")).alias(PLAN_ID), pack_hex(F.col("_etag")).alias(PLAN_ETAG),
                          *[q(c).alias(n) for c, n in times], *[q(c).alias(f"__o_{c}") for c in ob])
    old = old.join(keys, F.col("__ok") == F.col("__k"), "left_semi")
    extra = [n for _, n in times] + ([DEF_COL] if DEF_COL in incoming.columns else [])
    j = incoming.join(old, q(key) == F.col("__ok"), "left")
    new_types, old_types = _types(incoming, nb), _types(existing, ob)
    targets = settle(existing, old_types, new_types)
    merged = merge_columns(new_types, old_types, lambda c: q(c), lambda c: F.col(f"`__o_{c}`"), targets, filled)
    unfit = _unfit(new_types, targets, lambda c: q(c))
    op = F.when(unfit, F.lit(OP_REJECT)).when(F.col("__ok").isNull(), F.lit(OP_CREATE)).otherwise(F.lit(OP_UPDATE))
    return j.select(F.lit(collection).alias("collection"), op.alias("op"), *merged,
                    *[unpack_hex(F.col(c)).alias(c) for c in (PLAN_ID, PLAN_ETAG)], *[F.col(c) for c in extra])


def plan_creates(incoming: DataFrame, collection: str) -> DataFrame:
    """The plan against a collection that does not exist yet: every document is a CREATE (no join)."""
    nb = business_columns(incoming)
    extra = [DEF_COL] if DEF_COL in incoming.columns else []
    return incoming.select(F.lit(collection).alias("collection"), F.lit(OP_CREATE).alias("op"), *[q(c) for c in nb],
                           F.lit(None).cast("string").alias(PLAN_ID), F.lit(None).cast("string").alias(PLAN_ETAG),
                           *[F.col(c) for c in extra])


def grow_arrays(plan: DataFrame, existing: DataFrame, arrays: list[tuple[str, str | None]], rows: Column,
                key: str = KEY) -> DataFrame:
    """``plan`` (staged: it is read repeatedly) whose updates among ``rows`` keep the stored elements of ``arrays``.

    ``arrays`` holds (column, its inner tuple array if its elements are structs that have one, else None). The
    result is the set union that nesting both sides' rows together would give: sorted, each element once, and
    elements that differ in their inner tuples alone hold the tuples of both. Elements are exploded and grouped,
    so a document of many elements costs what they are. Tuples are positional: a stored array whose ``_cols``
    index is another one is replaced whole.
    """
    row = F.sha2(canonical_json([c for c in plan.columns if c not in ("collection", "op", PLAN_ID, PLAN_ETAG, PLAN_CREATED, PLAN_UPDATED)]), 256)
    plan = plan.withColumn("__r", F.when((F.col("op") == OP_UPDATE) & rows, row))
    for name, inner in arrays:
        if name not in existing.columns:
            continue
        dt = plan.schema[name].dataType
        index = f"{inner or name}_cols"
        new = plan.filter(F.col("__r").isNotNull()).dropDuplicates(["__r"])
        stored = existing.select(q(key).alias("__ok"), conform(q(name), existing.schema[name].dataType, dt).alias("__old"),
                                 *[q(c).alias("__oi") for c in [index] if c in existing.columns])
        same = q(key) == F.col("__ok")
        if index in plan.columns and index in existing.columns:
            same = same & q(index).eqNullSafe(F.col("__oi"))
        both = new.select("__r", F.explode(q(name)).alias("__e")).unionByName(
            stored.join(new, same).select("__r", F.explode("__old").alias("__e")))
        if inner:
            fields = [f.name for f in dt.elementType.fields]
            attrs = [f"__e{i}" for i, f in enumerate(fields) if f != inner]
            both = both.select("__r", *[F.col("__e").getField(f).alias(f"__e{i}") for i, f in enumerate(fields) if f != inner],
                               F.explode_outer(F.col("__e").getField(inner)).alias("__t"))
            both = both.groupBy("__r", *attrs).agg(F.sort_array(F.collect_set("__t")).alias("__t")).select("__r", F.struct(
                *[(F.col("__t") if f == inner else F.col(f"__e{i}")).alias(f) for i, f in enumerate(fields)]).alias("__e"))
        grown = both.groupBy(F.col("__r").alias("__gr")).agg(F.sort_array(F.collect_set("__e")).alias("__g"))
        plan = plan.join(grown, F.col("__r") == F.col("__gr"), "left").withColumn(
            name, F.coalesce("__g", q(name))).drop("__gr", "__g")
    return plan.drop("__r")


def batch_duplicates(incoming: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once in one batch, with their count."""
    return incoming.groupBy(q(key)).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


#: Repeated keys of one batch that may be broadcast to the batch.
MAX_BROADCAST_KEYS = 100_000


def dedup_plan(plan: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(one plan row per key, ``(key, op, n)``: how many further rows a repeated key has).

    The winner is the least (definition order, canonical JSON). Repeated keys are found on the key column
    alone; documents are only read and hashed for keys that do repeat, so a batch without repeats is passed
    through unshuffled. A key repeated a million times meets as per-task minima.
    """
    biz = business_columns(plan.drop("collection", "op"))
    order = F.struct((q(DEF_COL) if DEF_COL in plan.columns else F.lit(0)).alias("d"),
                     F.sha2(canonical_json(biz), 256).alias("j"))
    twice = batch_duplicates(plan, key).select(q(key).alias("__tk"))
    with freed_shuffles(plan.sparkSession):
        found = twice.limit(MAX_BROADCAST_KEYS + 1).count()
    if not found:
        none = plan.select(q(key), "op", F.lit(0).cast("long").alias("n")).where(F.lit(False))
        return plan, none
    few = found <= MAX_BROADCAST_KEYS
    slim = plan.join(F.broadcast(twice) if few else twice, q(key).eqNullSafe(F.col("__tk")), "left_semi").select(
        q(key).alias("__rk"), order.alias("__ro"), F.col("op").alias("__rop"))
    again = slim.groupBy("__rk").agg(F.min(F.struct("__ro", "__rop")).alias("__w"), F.count(F.lit(1)).alias("__n"))
    dups = again.select(F.col("__rk").alias(key), F.col("__w.__rop").alias("op"), (F.col("__n") - 1).alias("n"))
    keys = F.broadcast(again) if few else again
    once = plan.join(keys.select("__rk"), q(key) == F.col("__rk"), "left_anti")
    best = plan.join(keys.select("__rk", F.col("__w.__ro").alias("__ro")), (q(key) == F.col("__rk")) & (
        order == F.col("__ro"))).select(*[q(c) for c in plan.columns])
    return once.unionByName(best.dropDuplicates([key])), dups


def _stored_keys(current: DataFrame, keys: DataFrame, key: str, alias: str = "__ck") -> DataFrame:
    """Keys of ``current`` that are also in ``keys``, as one column ``alias``.

    The collection's key column meets the batch's keys in a left-semi join, which AQE broadcasts when the
    batch is small at run time, so the collection is streamed once and never shuffled to find out which
    batch keys it holds; the result is at most the batch's size.
    """
    k = keys.select(q(key).alias("__bk"))
    return current.select(q(key).alias(alias)).join(k, F.col(alias) == F.col("__bk"), "left_semi")


@dataclass
class _Applied:
    """A plan joined with the current version: what the new version and the outcome are made from."""
    refused: DataFrame  # plan rows that are rejected
    dups: DataFrame  # (key, op, n) of repeated keys
    stored: DataFrame  # stored documents, changed ones in their new content; with ``__upd`` and ``__op``
    missing: DataFrame  # plan rows whose key is not stored (any more)
    new_rows: DataFrame  # the documents created from them
    certain: bool  # no row can be rejected now that the plan has not rejected


def _untouched(current: DataFrame, updates: DataFrame, key: str, n: int) -> DataFrame | None:
    """Rows of ``current`` that a plan of ``n`` ``updates`` made against it leaves as they are.

    Found on the keys alone; rows of ``current`` are shuffled only where many are touched and many are not. None when
    a touched key is stored more than once, or some document has no version tag: then the tags decide, row by row.
    """
    few = n <= MAX_BROADCAST_KEYS
    keys = updates.select(q(key).alias("__uk"))
    if few:
        keys = F.broadcast(keys)
    met = q(key) == F.col("__uk")
    stored = current.select(q(key))
    with freed_shuffles(current.sparkSession):
        touched = stored.join(keys, met, "left_semi").count()
        if touched != updates.select(q(key)).distinct().count() or not current.filter(F.col("_etag").isNull()).isEmpty():
            return None
        left = current.count() - touched
    if not left:  # an empty branch, which the optimizer drops
        return current.where(F.lit(False))
    if few or left > MAX_BROADCAST_KEYS:
        return current.join(keys, met, "left_anti")
    rest = stored.join(keys, met, "left_anti").select(q(key).alias("__rk"))
    return current.join(F.broadcast(rest), q(key).eqNullSafe(F.col("__rk")), "left_semi")


def _applied(plan: DataFrame, current: DataFrame, collection: str, now: Column, key: str, unique: bool,
             creates: bool = True, updates: int | None = None) -> _Applied:
    """``creates``: whether the plan may hold a CREATE. ``updates``: it is known to hold that many, and to have been
    made against ``current`` itself, so all their keys are stored and those of its creates are not."""
    pb, cb = business_columns(plan.drop("collection", "op")), business_columns(current)
    new_types, old_types = _types(plan, pb), _types(current, cb)
    # types settle again: the collection may hold values now that it did not hold when the plan was made
    targets = settle(current, old_types, new_types)
    certain = all(exact(new_types[c], dt) for c, dt in targets.items())
    unfit = F.col("op") == OP_REJECT
    if not certain:
        unfit = unfit | _unfit(new_types, targets, lambda c: q(c))
    plan = plan.filter(q(key).isNotNull())
    refused = plan.filter(unfit)
    plan = plan.filter(~unfit)
    one, dups = (plan, None) if unique else dedup_plan(plan, key)
    pk = one.select(q(key).alias("__pk"), F.col("op").alias("__op"), F.col(PLAN_ETAG).alias("__pe"),
                    *[q(c).alias(f"__n_{c}") for c in pb])
    if updates == 0:  # no stored row meets the plan
        pk = pk.where(F.lit(False))
    is_update = (F.col("__op") == OP_UPDATE) & (F.col("_etag") == F.col("__pe"))
    names = list(dict.fromkeys(cb + pb))
    times = {"_created": PLAN_CREATED, "_updated": PLAN_UPDATED}
    rest = None
    if updates and certain and set(times.values()) <= set(plan.columns):
        rest = _untouched(current, plan.filter(F.col("op") == OP_UPDATE), key, updates)
    if rest is None:
        j = current.join(pk, q(key) == F.col("__pk"), "left")
    else:
        # what the join would give, without it: the updates beside the attributes of the documents they meet, and the others
        met = one.filter(F.col("op") == OP_UPDATE).select(
            F.col("op").alias("__op"), F.col(PLAN_ETAG).alias("__pe"), *[q(c).alias(f"__n_{c}") for c in pb],
            F.col(PLAN_ID).alias("_id"), F.col(PLAN_ETAG).alias("_etag"), *[F.col(n).alias(c) for c, n in times.items()])
        j = rest.unionByName(met, allowMissingColumns=True)

    def val(c: str) -> Column:
        if c in pb and c in cb:
            return _choose(is_update, F.col(f"`__n_{c}`"), new_types[c], q(c), old_types[c], targets[c])
        if c in pb:
            return F.when(is_update, F.col(f"`__n_{c}`"))
        return F.when(is_update, F.lit(None).cast(old_types[c])).otherwise(q(c))

    body = j.select(*[val(c).alias(c) for c in names], "_id", "_etag", "_created", "_updated",
                    is_update.alias("__upd"), "__op")
    new_etag = etag_col(names)
    changed = F.col("__upd") & (new_etag != F.col("_etag"))
    stored = body.select(*[q(c) for c in names], "_id",
                         F.when(changed, new_etag).otherwise(F.col("_etag")).alias("_etag"), "_created",
                         F.when(changed, now).otherwise(F.col("_updated")).alias("_updated"), "__upd", "__op")
    # plan rows whose key is not stored (any more): creates, or updates of a vanished document
    if updates is not None:
        missing = one
    else:
        missing = one.join(_stored_keys(current, one, key), q(key) == F.col("__ck"), "left_anti")
    if not creates:  # an empty branch, which the optimizer drops
        missing = missing.where(F.lit(False))
    new_rows = missing.filter(F.col("op") == OP_CREATE).select(
        *[q(c) for c in pb], doc_id_col(collection, q(key)).alias("_id"), etag_col(pb).alias("_etag"),
        now.alias("_created"), now.alias("_updated"))
    return _Applied(refused, dups, stored, missing, new_rows, certain)


def apply_plan(plan: DataFrame, current: DataFrame, collection: str, now: Column | None = None,
               key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(new version of the collection, outcome ``(collection, key, op, status, n)``: n plan rows).

    The version streams the current collection once through a left join with the (deduplicated) plan;
    the outcome needs only the key and ``_etag`` columns of the collection, which is all its scan reads.
    The plan is staged first, for it is read many times: its joins run once, and as a
    Parquet scan its size is known when the query is planned, so a small batch is broadcast and the
    collection is never shuffled for the join. :func:`apply_counted` gives the outcome's counts without joining again.
    """
    plan = _staged(plan)
    a = _applied(plan, current, collection, now if now is not None else F.current_timestamp(), key, False)
    lit_c = F.lit(collection).alias("collection")
    one_row = F.lit(1).cast("long").alias("n")
    hit = a.stored.filter(F.col("__op").isNotNull()).select(
        lit_c, q(key), F.col("__op").alias("op"),
        F.when(F.col("__upd"), F.lit(UPDATED)).otherwise(F.lit(CONFLICT)).alias("status"), one_row)
    miss = a.missing.select(lit_c, q(key), "op",
                            F.when(F.col("op") == OP_CREATE, F.lit(CREATED)).otherwise(F.lit(CONFLICT)).alias("status"), one_row)
    dup = a.dups.select(lit_c, q(key), "op", F.lit(DUPLICATE).alias("status"), "n")
    bad = a.refused.select(lit_c, q(key), "op", F.lit(REJECTED).alias("status"), one_row)
    return unite(a.stored.drop("__upd", "__op"), a.new_rows), hit.unionByName(miss).unionByName(dup).unionByName(bad)


def _staged(plan: DataFrame) -> DataFrame:
    path = scratch_path(plan.sparkSession, "plan")
    plan.write.option("compression", COMPRESSION).partitionBy("op").parquet(path)
    return plan.sparkSession.read.schema(plan.schema).parquet(path)


def observe_plan(plan: DataFrame, key: str = KEY) -> tuple[DataFrame, Observation]:
    """``plan`` that counts its rows with a key by ``op`` while it is written."""
    seen = Observation()
    ops = [F.count(F.when((F.col("op") == op) & q(key).isNotNull(), 1)).alias(op) for op in (OP_CREATE, OP_UPDATE, OP_REJECT)]
    return plan.observe(seen, *ops), seen


def apply_counted(plan: DataFrame, planned: dict[str, int], current: DataFrame, collection: str, now: Column | None = None,
                  key: str = KEY, unique: bool = False, same_base: bool = False) -> tuple[DataFrame, Callable[[], list[tuple[str, str, int]]]]:
    """(new version, its outcome as ``(op, status, n)`` once the version is written).

    ``planned``: rows of the plan by ``op`` (:func:`observe_plan`). Everything else is counted while the version is
    written, so neither collection nor plan is joined again. The counters sit in the writing stage, where a task
    counts once however often it was tried. ``unique``: the plan is known to hold each key once. ``same_base``:
    ``current`` is the very version that the plan was made against; creates then need no join, and updates one of keys.
    """
    now = now if now is not None else F.current_timestamp()
    creates = planned.get(OP_CREATE) != 0  # not counted: there may be some
    updates = planned.get(OP_UPDATE) if same_base else None
    a = _applied(plan, current, collection, now, key, unique, creates, updates)
    if not a.certain:  # a rare case: values that fitted when the plan was made, and no more
        version, outcome = apply_plan(plan, current, collection, now, key)
        return version, lambda: [tuple(r) for r in outcome.groupBy("op", "status").agg(F.sum("n")).collect()]  # a row per status
    hits, made = Observation(), Observation()
    met = F.col("__op").isNotNull() & ~F.coalesce(F.col("__upd"), F.lit(False))
    stored = a.stored.observe(hits, F.count(F.when(F.col("__upd"), 1)).alias("updated"),
                              F.count(F.when(met & (F.col("__op") == OP_CREATE), 1)).alias("known"))
    new_rows = a.new_rows.observe(made, F.count(F.lit(1)).alias("created"))
    with freed_shuffles(plan.sparkSession):
        again = {} if a.dups is None else {r[0]: r[1] for r in a.dups.groupBy("op").agg(F.sum("n")).collect()}  # a row per op

    def outcome() -> list[tuple[str, str, int]]:
        hit, new = hits.get, made.get
        created, updated = new.get("created", 0), hit.get("updated", 0)
        rows = [(OP_CREATE, CREATED, created), (OP_UPDATE, UPDATED, updated),
                (OP_CREATE, CONFLICT, hit.get("known", 0)),
                (OP_UPDATE, CONFLICT, planned.get(OP_UPDATE, 0) - again.get(OP_UPDATE, 0) - updated),
                (OP_REJECT, REJECTED, planned.get(OP_REJECT, 0)),
                *[(op, DUPLICATE, n) for op, n in again.items()]]
        return [r for r in rows if r[2]]

    return unite(stored.drop("__upd", "__op"), new_rows), outcome


def unite(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union by name, in the types of ``kept`` (every value of ``new`` fits them); missing columns are null."""
    kt, nt = _types(kept, kept.columns), _types(new, new.columns)
    return kept.unionByName(new.select(*[(conform(q(c), dt, kt[c]) if c in kt else q(c)).alias(c) for c, dt in nt.items()]),
                            allowMissingColumns=True)


def replace_by_key(current: DataFrame, docs: DataFrame, collection: str, overwrite: bool = False,
                   now: Column | None = None, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Insert-or-replace whole documents (no field merge) (K4).

    Status per document: ``NO_KEY`` (no key), ``EXISTS`` (key present, ``overwrite=False``),
    ``REPLACED`` (key present, ``overwrite=True``: whole row replaced, ``_id``/``_created`` kept),
    ``CREATED``, ``REJECTED`` (a value does not fit the stored type). Returns (new version, status).
    """
    now = now if now is not None else F.current_timestamp()
    nb = business_columns(docs)
    cb = business_columns(current)
    targets = settle(current, _types(current, cb), _types(docs, nb))
    unfit = _unfit(_types(docs, nb), targets, lambda c: q(c))
    valid = docs.filter(q(key).isNotNull() & ~unfit)
    one, _ = dedup_plan(valid.withColumn("op", F.lit(OP_CREATE)).withColumn("collection", F.lit(collection)), key)
    one = one.drop("op", "collection")
    nk = one.select(q(key).alias("__nk"), *[q(c).alias(f"__n_{c}") for c in nb])
    j = current.join(nk, q(key) == F.col("__nk"), "left")
    hit = F.col("__nk").isNotNull() & F.lit(overwrite)
    names = list(dict.fromkeys(cb + nb))

    def val(c: str) -> Column:
        if c in nb and c in cb:
            return _choose(hit, F.col(f"`__n_{c}`"), docs.schema[c].dataType, q(c), current.schema[c].dataType, targets[c])
        if c in nb:
            return F.when(hit, F.col(f"`__n_{c}`"))
        return F.when(hit, F.lit(None).cast(current.schema[c].dataType)).otherwise(q(c))

    body = j.select(*[val(c).alias(c) for c in names], "_id", "_created", "_updated", "_etag", hit.alias("__hit"))
    kept = body.select(*[q(c) for c in names], "_id",
                       F.when(F.col("__hit"), etag_col(names)).otherwise(F.col("_etag")).alias("_etag"),
                       "_created", F.when(F.col("__hit"), now).otherwise(F.col("_updated")).alias("_updated"))
    cur_keys = _stored_keys(current, valid, key)
    creates = one.join(cur_keys, q(key) == F.col("__ck"), "left_anti")
    new_rows = creates.select(*[q(c) for c in nb], doc_id_col(collection, q(key)).alias("_id"),
                              etag_col(nb).alias("_etag"), now.alias("_created"), now.alias("_updated"))
    version = unite(kept, new_rows)
    found = docs.join(cur_keys, q(key) == F.col("__ck"), "left")
    st = F.when(q(key).isNull(), F.lit(NO_KEY)).when(unfit, F.lit(REJECTED)) \
        .when(F.col("__ck").isNull(), F.lit(CREATED)) \
        .when(F.lit(overwrite), F.lit(REPLACED)).otherwise(F.lit(EXISTS))
    status = found.select(F.lit(collection).alias("collection"), q(key), st.alias("status"))
    return version, status


def delete_by_key(current: DataFrame, keys: DataFrame | list, key: str = KEY) -> DataFrame:
    """The collection without the given documents (K6); a key DataFrame becomes a left-anti join."""
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).cast("string").alias("__dk")).distinct()
        return current.join(k, q(key) == F.col("__dk"), "left_anti")
    return current.filter(~q(key).isin([str(x) for x in keys]) | q(key).isNull())

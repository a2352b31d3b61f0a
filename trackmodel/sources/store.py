"""Collection store: one versioned Parquet folder per collection under a shared root.

``<root>/<collection>/v000001/`` ... Every change writes a complete new version next to the current one;
a version counts once its ``_SUCCESS`` marker exists, so readers never see a half written version and a failed or
retried job leaves the current version untouched. Documents are rows; business columns may differ between
documents (missing = null) and widen over versions.

A writer claims the version after the one it read with a marker file that names its owner; only one can. A claim
whose file has not changed for ``claim_seconds`` may be taken over: the next attempt (``v000002-a2``) writes a folder
of its own. Before a writer commits it checks that its claim is still the last one and its own, and that no other
attempt has committed; else nothing of it counts and it gets :class:`VersionConflict`. So a writer that died blocks a
collection for a while only, and one that was merely slow cannot overwrite who came after it.

A version written in key order has a rank directory beside it (``v000003.ranks``: file, first key, rows, rows
before it), so any page is read from the files that hold it.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.functions.columns import SYSTEM_COLUMNS, doc_id_col, etag_col
from trackmodel.functions.pointers import KEY
from trackmodel.session import COMPRESSION, create_file, delete, file_times, freed_shuffles, glob_parents, list_dirs, read_file

_VERSION = re.compile(r"^v(\d{6})(?:-a(\d+))?$")
_CLAIM = re.compile(r"^v(\d{6})(?:-a(\d+))?\.claim$")
#: What may lie beside a version's folder.
_BESIDE = (".ranks", ".keys", ".keys.ranks")

#: Columns a batch or plan carries beside its documents.
PLAN_COLUMNS = ("__def", "__plan_etag", "__plan_id", "__plan_created", "__plan_updated")

EMPTY_SCHEMA = T.StructType([
    T.StructField(KEY, T.StringType()),
    T.StructField("_id", T.StringType()),
    T.StructField("_etag", T.StringType()),
    T.StructField("_created", T.TimestampType()),
    T.StructField("_updated", T.TimestampType()),
])


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SYSTEM_COLUMNS and c not in PLAN_COLUMNS]


def strip_system(df: DataFrame) -> DataFrame:
    """Business view of documents: system attributes dropped."""
    return df.drop(*[c for c in SYSTEM_COLUMNS if c in df.columns])


def with_system(df: DataFrame, collection: str, now: Column, key: str = KEY) -> DataFrame:
    """New documents: deterministic ``_id``, content ``_etag``, creation/update time."""
    biz = business_columns(df)
    return df.select(*[F.col(f"`{c}`") for c in biz],
                     doc_id_col(collection, F.col(key)).alias("_id"),
                     etag_col(biz).alias("_etag"),
                     now.alias("_created"), now.alias("_updated"))


#: Up to here a page of a version without a rank directory is a top-k, whose k grows with the page number.
MAX_TOP_ROWS = 100_000
#: Seconds after which the claim of a writer that has not committed may be taken over.
CLAIM_SECONDS = 6 * 3600


class VersionConflict(RuntimeError):
    """Another writer has taken the version that this write was to become."""


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str, key: str = KEY, claim_seconds: float = CLAIM_SECONDS):
        self.spark, self.root, self.key, self.claim_seconds = spark, root.rstrip("/"), key, claim_seconds

    # ---- versions -------------------------------------------------------------------------------
    def _folder(self, collection: str, version: int, attempt: int = 1) -> str:
        return f"{self.root}/{collection}/v{version:06d}" + (f"-a{attempt}" if attempt > 1 else "")

    def _committed(self, collection: str) -> dict[int, int]:
        """Committed versions and the attempt that made each (one glob for every ``_SUCCESS`` marker)."""
        names = glob_parents(self.spark, f"{self.root}/{collection}/v*/_SUCCESS")
        found = sorted((int(m.group(1)), int(m.group(2) or 1)) for m in map(_VERSION.match, names) if m)
        return dict(found)

    def path(self, collection: str, version: int) -> str:
        return self._folder(collection, version, self._committed(collection).get(version, 1))

    def versions(self, collection: str) -> list[int]:
        return sorted(self._committed(collection))

    def current_version(self, collection: str) -> int | None:
        v = self.versions(collection)
        return v[-1] if v else None

    def collections(self) -> list[str]:
        return sorted(c for c in list_dirs(self.spark, self.root) if self.versions(c))

    # ---- reads ----------------------------------------------------------------------------------
    def scan(self, collection: str, system: bool = True, version: int | None = None) -> DataFrame:
        """Whole collection (S5); an absent collection reads as empty."""
        v = version if version is not None else self.current_version(collection)
        if v is None:
            # an always-false filter: the optimizer sees an empty relation and prunes joins against it
            df = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in EMPTY_SCHEMA.fields]) \
                .where(F.lit(False))
        else:
            df = self.spark.read.parquet(self.path(collection, v))
        return df if system else strip_system(df)

    def page(self, collection: str, page: int, max_results: int = 25, system: bool = True) -> DataFrame:
        """Page ``page`` (1-based) of ``max_results`` documents in key order (S6), at any depth.

        A version with a rank directory is read from the files that hold the page, two at most unless they hold
        fewer rows than a page. Without one, early pages are a top-k per task; for deeper ones the keys alone are
        ranked once per version (range partitioned, kept beside it), and the page's documents are looked up.
        """
        if page < 1 or max_results < 1:
            raise ValueError("page and max_results start at 1")
        first = (page - 1) * max_results
        v = self.current_version(collection)
        if v is None:
            return self.scan(collection, system).limit(0)
        base = self.path(collection, v)
        if self._exists(f"{base}.ranks"):
            rows = self._ranked(base, first, max_results)
            return rows if system else strip_system(rows)
        df = self.scan(collection, system, v)
        if first + max_results <= MAX_TOP_ROWS:
            return df.orderBy(F.col(self.key)).offset(first).limit(max_results)
        if not self._exists(f"{base}.keys.ranks"):
            self._write_ordered(df.select(self.key), f"{base}.keys")
            self._write_ranks(f"{base}.keys")
        keys = self._ranked(f"{base}.keys", first, max_results)
        among = [r[0] for r in keys.collect()]  # one page of keys
        return df.filter(F.col(self.key).isin(among)).orderBy(F.col(self.key))

    def _exists(self, path: str) -> bool:
        return bool(glob_parents(self.spark, f"{path}/_SUCCESS"))

    def _write_ordered(self, df: DataFrame, path: str) -> None:
        df.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key).write.mode("overwrite").parquet(path)

    def _write_ranks(self, path: str) -> None:
        """The rank directory of a folder written in key order: a row per file."""
        per_file = self.spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(self.key).alias("first_key"), F.count(F.lit(1)).alias("rows"))
        before = Window.orderBy(F.col("first_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        per_file.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long"))).coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}.ranks")

    def _ranked(self, path: str, first: int, count: int) -> DataFrame:
        """Rows ``first`` to ``first + count`` in key order, from the files that hold them."""
        whole = self.spark.read.parquet(path)
        holds = self.spark.read.parquet(f"{path}.ranks").filter(
            (F.col("start") < first + count) & (F.col("start") + F.col("rows") > first)).orderBy("start")
        files = holds.select("file", "start").collect()  # the files of one page
        if not files:
            return whole.limit(0)
        rows = self.spark.read.schema(whole.schema).parquet(*[f["file"] for f in files])
        return rows.orderBy(F.col(self.key)).offset(first - files[0]["start"]).limit(count)

    def page_after(self, collection: str, after: str | None, max_results: int = 25, system: bool = True) -> DataFrame:
        """Keyset paging: the next ``max_results`` documents with a key greater than ``after``.

        The key filter reaches the Parquet scan and the top-k never grows with the page number.
        """
        df = self.scan(collection, system)
        if after is not None:
            df = df.filter(F.col(self.key) > F.lit(after))
        return df.orderBy(F.col(self.key)).limit(max_results)

    def lookup(self, collection: str, keys: DataFrame | list, by: str | None = None, system: bool = True) -> DataFrame:
        """Documents whose key or ``_id`` is among ``keys``; ``by`` restricts to one of the two.

        A list becomes an ``IN`` filter that reaches the Parquet scan; a DataFrame of keys becomes a
        left-semi join, which AQE turns into a broadcast when the key set is small at run time.
        """
        df = self.scan(collection, system=True)
        columns = [by] if by else [self.key, "_id"]
        if isinstance(keys, DataFrame):
            k = keys.select(F.col(keys.columns[0]).cast("string").alias("__k")).distinct()
            found = [df.join(k, F.col(c) == F.col("__k"), "left_semi") for c in columns]
            # a document found by its key is not returned again for its id
            out = found[0] if len(found) == 1 else found[0].unionByName(
                found[1].join(k, F.col(columns[0]) == F.col("__k"), "left_anti"))
        else:
            among = [F.col(c).isin([str(x) for x in keys]) for c in columns]
            out = df.filter(among[0] if len(among) == 1 else among[0] | among[1])
        return out if system else strip_system(out)

    # ---- writes ---------------------------------------------------------------------------------
    def _attempts(self, collection: str, version: int) -> dict[int, int]:
        """Attempts that claim a version, with the time of each claim."""
        found = file_times(self.spark, f"{self._folder(collection, version)}*.claim")
        return {int(m.group(2) or 1): t for m, t in ((_CLAIM.match(n), t) for n, t in found.items())
                if m and int(m.group(1)) == version}

    def claim(self, collection: str, base: int) -> "Claim":
        """The right to write the version after ``base``; :class:`VersionConflict` when somebody else has it."""
        version, owner = base + 1, f"{self.spark.sparkContext.applicationId} {uuid.uuid4().hex}"
        taken = VersionConflict(f"{collection}: version {version} is taken; apply again to the current version")
        if (self.current_version(collection) or 0) != base:
            raise taken
        made = self._attempts(collection, version)
        last = max(made, default=0)
        if last and time.time() - made[last] / 1000 < self.claim_seconds:
            raise taken
        path = self._folder(collection, version, last + 1)
        if not create_file(self.spark, f"{path}.claim", owner):
            raise taken
        return Claim(self, collection, version, last + 1, owner)

    def write_version(self, collection: str, df: DataFrame, base: int | None = None, ordered: bool = False) -> int:
        """Write ``df`` as the version after ``base`` and return its number (never overwrites what is read).

        ``base`` is the version ``df`` was made from (0: none; default: the current one). Who comes second gets
        :class:`VersionConflict` and applies again to the newer version, so no write is lost. ``ordered``: in key
        order, with a rank directory for :meth:`page`.
        """
        base = (self.current_version(collection) or 0) if base is None else base
        claim = self.claim(collection, base)
        if ordered:
            df = df.repartitionByRange(F.col(self.key)).sortWithinPartitions(self.key)
        # the marker is set below, after the claim has been checked
        w = df.write.mode("errorifexists").options(compression=COMPRESSION).option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        # Parquet bloom filters on the lookup columns: a keyed lookup (= or IN, pushed to the scan) skips
        # every row group that cannot hold the key, whatever order the documents were written in; each as large
        # as the row group's values need, not 1 MB
        w = w.option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in (self.key, "_id"):
            if c in df.columns:
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        try:
            with freed_shuffles(df.sparkSession):
                w.parquet(claim.path)
            if ordered:
                self._write_ranks(claim.path)
            claim.commit()
        except Exception:
            claim.give_up()
            raise
        return claim.version

    def order(self, collection: str) -> int:
        """Write the current version again in key order, with its rank directory; documents and tags do not change."""
        return self.write_version(collection, self.scan(collection), self.current_version(collection), ordered=True)

    def release(self, collection: str, version: int) -> None:
        """Give up an uncommitted version at once: all its attempts and claims go; a committed one is left alone."""
        if version not in self.versions(collection):
            for attempt in self._attempts(collection, version):
                self._remove(self._folder(collection, version, attempt))

    def _remove(self, folder: str) -> None:
        for path in [folder, f"{folder}.claim", *[folder + b for b in _BESIDE]]:
            delete(self.spark, path)

    def vacuum(self, collection: str, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions (1 at least); returns the deleted numbers."""
        old = self.versions(collection)[:-max(1, keep)]
        for v in old:
            for attempt in {1, *self._attempts(collection, v), self._committed(collection).get(v, 1)}:
                self._remove(self._folder(collection, v, attempt))
        return old

    def drop(self, collection: str) -> None:
        """Delete a whole collection, all versions."""
        delete(self.spark, f"{self.root}/{collection}")

    def initialize(self, collection: str, docs: DataFrame, now: Column | None = None) -> int:
        """Create a collection from documents without system attributes."""
        now = now if now is not None else F.current_timestamp()
        return self.write_version(collection, with_system(docs, collection, now, self.key))


class Claim:
    """One attempt at a version: its folder counts once committed."""

    def __init__(self, store: CollectionStore, collection: str, version: int, attempt: int, owner: str):
        self.store, self.collection, self.version, self.attempt, self.owner = store, collection, version, attempt, owner
        self.path = store._folder(collection, version, attempt)

    def holds(self) -> bool:
        """Whether this is still the last claim, its owner's, on a version that nobody has committed."""
        s = self.store
        return (max(s._attempts(self.collection, self.version), default=0) == self.attempt
                and read_file(s.spark, f"{self.path}.claim") == self.owner
                and self.version not in s._committed(self.collection))

    def commit(self) -> None:
        if not self.holds():
            raise VersionConflict(f"{self.collection}: version {self.version} went to another writer; apply again")
        create_file(self.store.spark, f"{self.path}/_SUCCESS")

    def give_up(self) -> None:
        """Remove what this attempt wrote, and its claim if it is still its own."""
        if read_file(self.store.spark, f"{self.path}.claim") == self.owner:
            self.store._remove(self.path)

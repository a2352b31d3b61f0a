"""Session helpers: a tuned local session for tests/bench, and the shared folder for lineage cuts."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import InheritableThread
from pyspark.sql import SparkSession

_SCRATCH = "trackmodel-scratch"
#: Of the Parquet that stores and staging folders hold: version tags and ids are hex digits, which take half the space so.
COMPRESSION = "zstd"


def get_spark(master: str | None = None, app: str = "trackmodel", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library is written against.

    AQE stays on so Spark coalesces small shuffles, splits skewed partitions and turns joins into
    broadcasts only when the runtime size of a side is known to be small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.scheduler.mode": "FAIR",  # jobs submitted together share the executors
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Session settings sized for an input of ``input_bytes`` (pass to ``get_spark(extra=...)``).

    Scans are split into ``partition_bytes`` pieces; the shuffle starts with as many partitions as the
    input has pieces (a nest's shuffle is at most its input, usually much less after map-side combine)
    and AQE coalesces them to about ``partition_bytes`` each, splitting any join partition five times
    larger than the median. Example: 100 TB at 256 MB gives ~400k scan tasks and 400k initial shuffle
    partitions, which AQE coalesces to what the data actually needs.
    """
    pieces = max(1, -(-int(input_bytes) // int(partition_bytes)))
    size = str(int(partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.shuffle.partitions": str(max(200, pieces)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
    }


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets one, below its warehouse folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder (format round trips, stores, staged plans)."""
    return f"{shared_dir(spark)}/{_SCRATCH}/{uuid.uuid4().hex}/{name}"


def together(spark: SparkSession, tasks: list[Callable], limit: int = 8) -> list:
    """Run independent tasks at once, ``limit`` at most; their results in the order of ``tasks``.

    Every task submits its own Spark jobs (each thread in a scheduler pool of its own). The first failure cancels the
    jobs of the others, keeps waiting tasks from starting, and is raised.
    """
    if len(tasks) < 2:
        return [t() for t in tasks]
    sc, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"
    results: list = [None] * len(tasks)
    waiting, failed, lock = list(enumerate(tasks)), [], threading.Lock()

    def work(pool: str) -> None:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", pool)
        while True:
            with lock:
                if failed or not waiting:
                    return
                i, task = waiting.pop(0)
            try:
                results[i] = task()
            except BaseException as e:  # handed to the caller below
                with lock:
                    failed.append(e)
                sc.cancelJobsWithTag(tag)
                return

    threads = [InheritableThread(target=work, args=(f"{tag}-{k}",)) for k in range(min(limit, len(tasks)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return results


#: Spark's setting to remove the shuffle files of a query when the query ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict[str, int] = {}
_freeing_lock = threading.Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run inside are removed when each query ends.

    Without it they stay until the driver collects its garbage, so an import holds on disk what all its steps have
    shuffled. For queries that nothing runs again: a frame that is, computes its shuffles anew. May be nested and used
    by several threads; a session's own setting is kept.
    """
    session = spark._jsparkSession.sessionUUID()
    with _freeing_lock:
        if session in _freeing:
            _freeing[session] += 1
            ours = True
        else:
            ours = spark.conf.get(_FREE, None) is None
            if ours:
                spark.conf.set(_FREE, "true")
                _freeing[session] = 1
    try:
        yield
    finally:
        with _freeing_lock:
            if ours:
                _freeing[session] -= 1
                if not _freeing[session]:
                    del _freeing[session]
                    spark.conf.unset(_FREE)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path`` (0: there is no such folder)."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_file(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file that holds ``text``; False when it is there already. Only one caller succeeds."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(text.encode("utf-8"))
    out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """Text of a small file (None: no such file)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    source = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    stream = fs.open(p)
    data = bytes(source.readFullyToByteArray(stream))
    stream.close()
    return data.decode("utf-8")


def file_times(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Names of the files that match ``pattern``, with the file system's time of their last change (epoch ms)."""
    fs, p = _fs(spark, pattern)
    return {st.getPath().getName(): st.getModificationTime() for st in fs.globStatus(p) or []}


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` on any Hadoop-compatible file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def glob_parents(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the parent folders of every path matching ``pattern`` (one file-system call)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return [] if found is None else [st.getPath().getParent().getName() for st in found]


__all__ = ["get_spark", "scale_conf", "shared_dir", "scratch_path", "together", "freed_shuffles", "stored_bytes", "create_file", "read_file", "file_times", "delete", "list_dirs", "glob_parents"]

import os

import pytest

from tests.conftest import LOG_MAPPING, log_lines, n_points, write_log
from trackmodel.session import scratch_path
from trackmodel.sources.store import CollectionStore
from trackmodel.streaming import file_drop_import


@pytest.mark.parametrize("per_batch", [1, 2])
def test_file_drop_keeps_every_file(spark, local_dir, tmp, per_batch):
    folder = os.path.join(local_dir, "drop")
    os.makedirs(folder)
    for i, t0 in enumerate([1700000000000, 1710000000000]):
        write_log(folder, f"log{i}.csv", log_lines(stamps=4, t0=t0))
    store = CollectionStore(spark, tmp)
    q = file_drop_import(spark, LOG_MAPPING, folder, store, scratch_path(spark, "stream-ckpt"), files_per_batch=per_batch)
    q.awaitTermination(300)
    assert q.exception() is None
    assert store.scan("Houses").count() == 2
    logs = {r["schema_identifier"]: n_points(r) for r in store.scan("Logs").collect()}
    # slices count from the epoch: both files' documents stand side by side however they were batched
    assert logs == {f"H{h}__240s_{t0 // 240_000 + 1 + late}": n for t0 in (1700000000000, 1710000000000)
                    for h in (0, 1) for late, n in slices(t0, h).items()}


def test_files_that_share_a_slice_add_up(spark, local_dir):
    lines = log_lines(stamps=8)
    whole = None
    # cut within a slice, and within one moment: the moment at the cut has probes in both files
    for per_batch in (2, 1):
        folder = os.path.join(local_dir, f"drop{per_batch}")
        os.makedirs(folder)
        write_log(folder, "log0.csv", lines[:10])
        write_log(folder, "log1.csv", lines[10:])
        store = CollectionStore(spark, scratch_path(spark, "t"))
        for _ in range(2):  # the second time all files are imported again: nothing changes
            q = file_drop_import(spark, LOG_MAPPING, folder, store, scratch_path(spark, "stream-ckpt"), files_per_batch=per_batch)
            q.awaitTermination(300)
            assert q.exception() is None
            logs = {r["schema_identifier"]: r.asDict(True) for r in store.scan("Logs").drop("_id", "_etag", "_created", "_updated").collect()}
            whole = whole or logs
            assert logs == whole
    assert sum(map(n_points, whole.values())) == len(lines)


def slices(t0, house):
    out = {}
    for line in log_lines(stamps=4, t0=t0):
        stamp, own = line.split("|")[:2]
        if own == f"H{house}":
            k = int(stamp) // 240_000 - t0 // 240_000
            out[k] = out.get(k, 0) + 1
    return out

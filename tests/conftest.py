import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trackmodel.session import get_spark

    s = get_spark("local[4]", app="trackmodel-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def tmp(spark):
    """A fresh folder under the session's shared folder."""
    from trackmodel.session import scratch_path

    return scratch_path(spark, "t")


@pytest.fixture()
def local_dir():
    return tempfile.mkdtemp(prefix="tm-test-")


# A greenhouse log: 6 probes in 3 beds of 2 houses, a reading of most of them every 30 seconds.
HEADER = "stamp|house|bed|probe|temp|humid %|note"


def log_lines(stamps=20, probes=6, t0=1700000000000, step=30_000):
    return [f"{t0 + step * t}|H{p % 2}|B{p % 3}|{p}|{15 + p + t / 10}|{'' if p == 1 else 40 + t}|" for t in range(stamps)
            for p in range(probes) if (t + p) % 4]


def write_log(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(HEADER + "\n" + "\n".join(lines) + "\n")
    return path


@pytest.fixture()
def log_file(local_dir):
    return write_log(local_dir, "log.csv", log_lines())


#: A document per house and four minutes, with the curve of each of its probes; then what the log mentions.
CURVES = {"a": "collection", "partition": {"ts_field": "stamp", "interval": "240s"}, "schema_identifier": "house",
          "probes": {"points": {"temp": "temp", "a": "nested_array", "additional_fields": ["humid %"], "a_id": "stamp"},
                     "a": "nested_collection", "unit": "dshs#mapping_celsius", "n_id": "probe"}}
LOG_MAPPING = {
    "data": {"Logs": [CURVES],
             "Probes": [{"bed": "bed", "a": "collection", "schema_identifier": "probe"}],
             "Houses": [{"site": "dshs#mapping_north", "a": "collection", "schema_identifier": "house"}]},
    "file": {"timestamp_format": "ms", "header": "True", "delimiter": "|", "format": "csv"},
    "name": "greenhouse",
}


def n_points(doc, name="probes"):
    return sum(len(m["points"]) for m in doc[name])

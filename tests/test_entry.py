import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_registry_complete():
    own = set(entry.queries()) - set(entry.LLM_QUERIES)
    assert own == set(entry.oracle_sql()) - set(entry.LLM_ORACLES)
    assert len(own) >= 50


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["collection", "schema_identifier", "n_items", "n_tuples", "total"]
    assert {r["collection"] for r in rows} == {"Feeds", "Users", "Kinds", "Activity"}
    assert {r["schema_identifier"] for r in rows if r["collection"] == "Feeds"} == {"activity", "CREATE CREATED"}


@pytest.mark.parametrize("name", ["ingest_flat", "nest_two_level", "upsert_merge", "sibling_unnest", "time_partition",
                                  "describe_schema"])
def test_queries_match_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_SMALL)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(dict(zip(dcols, r))[c] for c in order) for r in res.fetchall()), key=repr)
    assert got == want


# plan nodes the library must never produce: pair enumeration, Python in the row path, row sampling
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "Sample "]


def test_no_query_plans_forbidden_nodes(spark):
    bad = {}
    for name, make in sorted(entry.queries().items()):
        if name in entry.LLM_QUERIES:
            continue
        plan = make(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        found = [f for f in FORBIDDEN if f in plan]
        if found:
            bad[name] = found
    assert bad == {}

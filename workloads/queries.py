"""Registered queries: one per inventory operator, each with its DuckDB oracle where SQL can express it.

Every query reads the driver tables (or files Spark derives from them) in full. Outputs are flat and
hash-safe: nested results are reported through sizes, first elements and joined id lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmodel.functions.columns import pack_hex, urlify_col
from trackmodel.functions.pointers import KEY
from trackmodel.operators import nest, timeparts, unnest, upsert
from trackmodel.operators.report import import_counts, import_outcome, with_provenance
from trackmodel.plans.extract import extract_definition, rejected_rows, union_definitions
from trackmodel.plans.ingest import ingest, stage_documents, stage_plan
from trackmodel.plans.mapping import parse_definition, parse_mapping
from trackmodel.session import scratch_path
from trackmodel.sources.files import read_source, split_broken
from trackmodel.sources.schema import describe_schema
from trackmodel.sources.store import CollectionStore, VersionConflict, strip_system
from trackmodel.sources.variant import read_variant
from workloads import shapes
from workloads.shapes import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def d(body: dict, collection: str = "C", inputs: dict | None = None):
    return parse_definition(collection, {"a": "collection", **body}, inputs=inputs)


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def ids(arr: Column, pick) -> Column:
    """Comma list of integer members of a nested list (order kept): hash-safe view of a nested value."""
    return F.array_join(F.transform(arr, lambda x: pick(x).cast("long").cast("string")), ",")


EV_MS = "(epoch_us(ts) // 1000)"

# ---------------------------------------------------------------- S: sources


@query("scan_csv", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
""")
def scan_csv(spark, sf):
    df = read_source(spark, {"format": "csv", "delimiter": ";", "header": "True"}, shapes.customer_csv(spark, sf))
    return df.select(long("c_custkey").alias("c_custkey"), "c_name", long("c_nationkey").alias("c_nationkey"))


@query("scan_json", """
SELECT o_orderkey, o.o_custkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""")
def scan_json(spark, sf):
    df = read_source(spark, {"format": "json"}, shapes.orders_json(spark, sf))
    u, a = unnest.unnest(df, [("lines",)])
    line = F.col(a[("lines",)])
    return u.select("o_orderkey", F.col("header.o_custkey").alias("o_custkey"),
                    line.l_linenumber.alias("l_linenumber"), line.l_partkey.alias("l_partkey"),
                    line.l_quantity.alias("l_quantity"))


VARIANT_MAPPING = {
    "name": "line_logs",
    "file": {"format": "json", "variant": "True", "timestamp_format": "ms",
             "types": {"log.[0]": "long", "log.[2].[0].[0]": "double", "log.[2].[0].[1]": "long"}},
    "data": {"Lines": [{"a": "collection", KEY: "order", "line": "log/[0]", "flag": "log/[1]", "qty": "log/[2].[0].[0]",
                        "part": "log/[2].[0].[1]"}]},
}


@query("scan_json_variant", """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS schema_identifier, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag,
       l_quantity AS qty, l_partkey AS part FROM lineitem
""")
def scan_json_variant(spark, sf):
    """Lines whose log entries mix a number, a text and a nested list: ``[no, "flag", [[qty, part]]]``, read as VARIANT."""
    entry = F.format_string('[%d,"%s",[[%s,%d]]]', "l_linenumber", "l_returnflag", F.col("l_quantity").cast("string"), "l_partkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("log"))
    text = F.format_string('{"order":%d,"log":[%s]}', "l_orderkey", F.array_join("log", ","))
    path = shapes.write(lines.select(text.alias("value")), "text", "line-logs", sf)
    m = parse_mapping(VARIANT_MAPPING)
    one = m.collections["Lines"][0]
    good, _ = split_broken(read_variant(spark, path, one.pointers()))
    return extract_definition(good, one)


@query("scan_xml", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
""")
def scan_xml(spark, sf):
    df = read_source(spark, {"format": "xml", "rowTag": "customer"}, shapes.customer_xml(spark, sf))
    return df.select(long("c_custkey").alias("c_custkey"), "c_name", long("c_nationkey").alias("c_nationkey"))


_DESCRIBE_NODES = [
    (0, 0, "header", "header", "struct", "(SELECT count(*) FROM orders)"),
    (1, 1, "o_custkey", "header.o_custkey", "long", "(SELECT count(o_custkey) FROM orders)"),
    (2, 1, "o_orderpriority", "header.o_orderpriority", "string", "(SELECT count(o_orderpriority) FROM orders)"),
    (3, 1, "o_orderstatus", "header.o_orderstatus", "string", "(SELECT count(o_orderstatus) FROM orders)"),
    (4, 1, "pair", "header.pair", "array", "(SELECT count(*) FROM orders)"),
    (5, 2, "_element", "header.pair[]", "long", "(SELECT 2 * count(*) FROM orders)"),
    (6, 0, "lines", "lines", "array", "(SELECT count(*) FROM orders)"),
    (7, 1, "l_linenumber", "lines.l_linenumber", "long", "(SELECT count(*) FROM lineitem)"),
    (8, 1, "l_partkey", "lines.l_partkey", "long", "(SELECT count(*) FROM lineitem)"),
    (9, 1, "l_quantity", "lines.l_quantity", "double", "(SELECT count(*) FROM lineitem)"),
    (10, 1, "l_returnflag", "lines.l_returnflag", "string", "(SELECT count(*) FROM lineitem)"),
    (11, 1, "l_suppkey", "lines.l_suppkey", "long", "(SELECT count(*) FROM lineitem)"),
    (12, 0, "o_orderkey", "o_orderkey", "long", "(SELECT count(*) FROM orders)"),
    (13, 0, "o_ts_ms", "o_ts_ms", "long", "(SELECT count(*) FROM orders)"),
    (14, 0, "returns", "returns", "array", "(SELECT count(*) FROM orders)"),
    (15, 1, "l_linenumber", "returns.l_linenumber", "long", "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')"),
    (16, 1, "l_partkey", "returns.l_partkey", "long", "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')"),
    (17, 1, "l_quantity", "returns.l_quantity", "double", "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')"),
    (18, 1, "l_returnflag", "returns.l_returnflag", "string", "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')"),
    (19, 1, "l_suppkey", "returns.l_suppkey", "long", "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')"),
]


@query("describe_schema", " UNION ALL ".join(
    f"SELECT CAST({o} AS BIGINT) AS ord, CAST({lv} AS BIGINT) AS level, '{n}' AS name, '{p}' AS path, "
    f"'{t}' AS type, CAST({c} AS BIGINT) AS non_null" for o, lv, n, p, t, c in _DESCRIBE_NODES))
def describe_schema_q(spark, sf):
    df = read_source(spark, {"format": "json"}, shapes.orders_json(spark, sf))
    return describe_schema(df).select(long("ord").alias("ord"), long("level").alias("level"), "name", "path", "type",
                                      long("non_null").alias("non_null"))


def _participants_store(spark, sf) -> CollectionStore:
    store = CollectionStore(spark, scratch_path(spark, "store"))
    c = table(spark, sf, "customer")
    docs = c.select(F.col("c_custkey").cast("string").alias(KEY), F.col("c_name").alias("name"),
                    long("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    store.initialize("Participants", docs)
    return store


_ID_SQL = "substr(sha256('Participants|' || CAST(c_custkey AS VARCHAR)), 1, 24)"


@query("collection_scan", f"""
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
       c_mktsegment AS segment, {_ID_SQL} AS _id
FROM customer
""")
def collection_scan(spark, sf):
    return _participants_store(spark, sf).scan("Participants").select(KEY, "name", "nation", "segment", "_id")


@query("collection_page", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name
FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 25 OFFSET 50
""")
def collection_page(spark, sf):
    return _participants_store(spark, sf).page("Participants", 3, 25).select(KEY, "name")


@query("collection_page_after", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name
FROM customer WHERE CAST(c_custkey AS VARCHAR) > '1049' ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 25
""")
def collection_page_after(spark, sf):
    return _participants_store(spark, sf).page_after("Participants", "1049", 25).select(KEY, "name")


@query("page_by_rank", """
SELECT CAST(o_orderkey AS VARCHAR) AS schema_identifier, o_orderstatus AS status
FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 1000
""")
def page_by_rank(spark, sf):
    """Page 41 of a collection written in key order, read through its rank directory."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    o = table(spark, sf, "orders")
    store.initialize("Orders", o.select(F.col("o_orderkey").cast("string").alias(KEY), F.col("o_orderstatus").alias("status")))
    store.order("Orders")
    return store.page("Orders", 41, 25).select(KEY, "status")


@query("lookup_by_key", f"""
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name, {_ID_SQL} AS _id
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def lookup_by_key(spark, sf):
    keys = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return _participants_store(spark, sf).lookup("Participants", keys).select(KEY, "name", "_id")


# ---------------------------------------------------------------- P: projections


@query("project_alias", """
SELECT DISTINCT CAST(event_id AS VARCHAR) AS schema_identifier, user_id AS "user", event_type AS kind, value AS amount
FROM events
""")
def project_alias(spark, sf):
    df = extract_definition(table(spark, sf, "events"),
                            d({KEY: "event_id", "user": "user_id", "kind": "event_type", "amount": "value"}))
    return df


@query("struct_field", """
SELECT CAST(o_orderkey AS VARCHAR) AS schema_identifier, o_custkey AS customer, o_orderpriority AS priority
FROM orders
""")
def struct_field(spark, sf):
    src = shapes.orders_file(spark, sf)
    return extract_definition(src, d({KEY: "o_orderkey", "customer": "header.o_custkey",
                                      "priority": "header.o_orderpriority"}))


@query("array_index", """
SELECT CAST(o_orderkey AS VARCHAR) AS schema_identifier, o_orderkey AS first, o_custkey AS second,
       CAST(NULL AS BIGINT) AS sixth
FROM orders
""")
def array_index(spark, sf):
    src = shapes.orders_file(spark, sf)
    return extract_definition(src, d({KEY: "o_orderkey", "first": "header.pair.[0]", "second": "header.pair.[1]",
                                      "sixth": "header.pair.[5]"}))


@query("literal_pointer", """
SELECT DISTINCT CAST(event_id AS VARCHAR) AS schema_identifier, 'events' AS source, '6' AS version, event_type AS kind
FROM events
""")
def literal_pointer(spark, sf):
    return extract_definition(table(spark, sf, "events"), d({KEY: "event_id", "source": "dshs#mapping_events",
                                                             "version": "dshs#mapping_6", "kind": "event_type"}))


@query("input_pointer", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS schema_identifier, 'ops-team' AS operator FROM events
""")
def input_pointer(spark, sf):
    return extract_definition(table(spark, sf, "events"), d({KEY: "user_id", "operator": "dshs#input"},
                                                            inputs={"operator": "ops-team"}))


@query("feature_constants", """
SELECT DISTINCT CAST(event_type AS VARCHAR) AS schema_identifier, 'driver-events' AS source_name,
       'v1' AS source_version
FROM events
""")
def feature_constants(spark, sf):
    mapping = {"name": "features", "file": {"format": "csv"},
               "data": {"source_name": {"a": "feature", "value": "dshs#input", "description": "Source name"},
                        "source_version": {"a": "feature", "value": "dshs#mapping_v1"},
                        "Teams": [{"a": "collection", KEY: "event_type"}]}}
    m = parse_mapping(mapping, inputs={"source_name": "driver-events"})
    from trackmodel.plans.ingest import extract_documents
    docs, _ = extract_documents(table(spark, sf, "events"), m, tag=False)
    return docs["Teams"]


@query("additional_fields", """
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS schema_identifier, CAST(p_size AS BIGINT) AS p_sizecm,
       p_retailprice AS retail_price_USD, p_type AS parttype_class
FROM part
""")
def additional_fields(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("part key"), long("p_size").alias("p size/cm"),
                                        F.col("p_retailprice").alias("retail price ($USD)"),
                                        F.col("p_type").alias("part-type  class"))
    return extract_definition(p, d({KEY: "part key", "additional_fields": ["p size/cm", "retail price ($USD)",
                                                                          "part-type  class"]}))


@query("urlify_column", r"""
SELECT p_partkey,
       regexp_replace(regexp_replace(p_name, '[^\w\s]', '', 'g'), '\s+', '_', 'g') AS name_url,
       regexp_replace(regexp_replace(p_brand, '[^\w\s]', '', 'g'), '\s+', '_', 'g') AS brand_url,
       regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^\w\s]', '', 'g'), '\s+', '_', 'g') AS label_url
FROM part
""")
def urlify_column(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", urlify_col("p_name").alias("name_url"), urlify_col("p_brand").alias("brand_url"),
                    urlify_col(F.concat_ws(" / ", "p_name", "p_type")).alias("label_url"))


@query("strip_system", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation,
       c_mktsegment AS segment
FROM customer
""")
def strip_system_q(spark, sf):
    return strip_system(_participants_store(spark, sf).scan("Participants"))


@query("key_to_string", """
SELECT CAST(o_orderkey AS VARCHAR) AS schema_identifier, o_orderkey, o_orderstatus AS status FROM orders
""")
def key_to_string(spark, sf):
    o = table(spark, sf, "orders")
    docs = extract_definition(o, d({KEY: "o_orderkey", "status": "o_orderstatus"}))
    return docs.withColumn("o_orderkey", long(KEY))


@query("rejected_rows", f"""
WITH e AS (SELECT nullif(user_id, 0) AS uid, event_id, event_id % 7 = 0 AS untimed FROM events)
SELECT CAST(uid AS VARCHAR) AS schema_identifier, 'NO_TIMESTAMP' AS reason, count(*) AS n FROM e WHERE untimed GROUP BY uid
UNION ALL
SELECT CAST(NULL AS VARCHAR), 'NO_KEY', count(*) FROM e WHERE uid IS NULL AND NOT untimed HAVING count(*) > 0
""")
def rejected_rows_q(spark, sf):
    e = table(spark, sf, "events")
    e = e.select(F.nullif(F.col("user_id"), F.lit(0)).alias("uid"), "event_id",
                 F.when(F.col("event_id") % 7 == 0, "no time").otherwise(shapes.epoch_ms("ts").cast("string")).alias("at"))
    one = d({KEY: "uid", "event": "event_id", "partition": {"interval": "24h", "ts_field": "at"}})
    rejected = rejected_rows(e, [one])
    return rejected.groupBy(KEY, "reason").agg(F.count(F.lit(1)).alias("n"))


@query("time_range_filter", f"""
SELECT event_id, {EV_MS} AS ts_ms FROM events
WHERE {EV_MS} BETWEEN 1704844800000 AND 1705708799999
""")
def time_range_filter(spark, sf):
    # 2024-01-10T00:00:00Z .. 2024-01-19T23:59:59.999Z, both ends inclusive; the range reaches the scan
    e = timeparts.time_range_filter(table(spark, sf, "events"), "ts", 1704844800000, 1705708799999)
    return timeparts.normalize_ts(e, "ts", out="ts_ms").select("event_id", "ts_ms")


# ---------------------------------------------------------------- U: unnest


@query("explode_one", """
SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def explode_one(spark, sf):
    src = shapes.orders_file(spark, sf)
    out = unnest.explode_one(src, "lines", "line")
    return out.select("o_orderkey", long("line.l_linenumber").alias("l_linenumber"),
                      F.col("line.l_partkey").alias("l_partkey"))


@query("explode_nested", """
SELECT c_custkey, o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
""")
def explode_nested(spark, sf):
    src = shapes.customer_orders_file(spark, sf)
    u, a = unnest.unnest(src, [("orders", "lines")])
    o, li = F.col(a[("orders",)]), F.col(a[("orders", "lines")])
    return u.select("c_custkey", o.o_orderkey.alias("o_orderkey"), long(li.l_linenumber).alias("l_linenumber"),
                    li.l_partkey.alias("l_partkey"))


@query("explode_struct_path", """
SELECT c_custkey, o_orderkey, o_orderpriority, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
""")
def explode_struct_path(spark, sf):
    src = shapes.customer_orders_file(spark, sf, via_struct=True)
    u, a = unnest.unnest(src, [("orders", "detail.lines")])
    o, li = F.col(a[("orders",)]), F.col(a[("orders", "detail.lines")])
    return u.select("c_custkey", o.o_orderkey.alias("o_orderkey"), o.detail.o_orderpriority.alias("o_orderpriority"),
                    long(li.l_linenumber).alias("l_linenumber"), li.l_partkey.alias("l_partkey"))


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag"


@query("sibling_unnest", f"""
WITH a AS (SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn
           FROM lineitem),
     r AS (SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn
           FROM lineitem WHERE l_returnflag = 'R')
SELECT a.l_orderkey AS o_orderkey, a.l_partkey AS line_part, r.l_partkey AS return_part
FROM a LEFT JOIN r ON a.l_orderkey = r.l_orderkey AND a.rn = r.rn
""")
def sibling_unnest(spark, sf):
    src = shapes.orders_file(spark, sf)
    u, a = unnest.unnest(src, [("lines",), ("returns",)])
    return u.select("o_orderkey", F.col(a[("lines",)]).l_partkey.alias("line_part"),
                    F.col(a[("returns",)]).l_partkey.alias("return_part"))


@query("shared_prefix", """
SELECT c_custkey, o_orderkey, o_orderstatus, l_partkey
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
""")
def shared_prefix(spark, sf):
    src = shapes.customer_orders_file(spark, sf)
    paths = [("orders",), ("orders",), ("orders", "lines")]  # three pointers, one explode of `orders`
    u, a = unnest.unnest(src, paths)
    o, li = F.col(a[("orders",)]), F.col(a[("orders", "lines")])
    return u.select("c_custkey", o.o_orderkey.alias("o_orderkey"), o.o_orderstatus.alias("o_orderstatus"),
                    li.l_partkey.alias("l_partkey"))


@query("explode_drops_empty", """
SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
""")
def explode_drops_empty(spark, sf):
    src = shapes.orders_file(spark, sf)
    out = unnest.explode_one(src, "returns", "r")
    return out.select("o_orderkey", F.col("r.l_partkey").alias("l_partkey"))


@query("explode_keeps_empty", """
SELECT o_orderkey, l_partkey
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') r ON r.l_orderkey = o_orderkey
""")
def explode_keeps_empty(spark, sf):
    src = shapes.orders_file(spark, sf)
    out = unnest.explode_one(src, "returns", "r", outer=True)
    return out.select("o_orderkey", F.col("r.l_partkey").alias("l_partkey"))


# ---------------------------------------------------------------- A: re-nest


@query("distinct_project", """
SELECT DISTINCT l_returnflag AS schema_identifier, l_linestatus AS status, strftime(l_shipdate, '%Y-%m') AS month
FROM lineitem
""")
def distinct_project(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("ship month", F.date_format("l_shipdate", "yyyy-MM"))
    return extract_definition(li, d({KEY: "l_returnflag", "status": "l_linestatus", "month": "ship month"}))


@query("nest_array", f"""
WITH e AS (SELECT user_id, event_id, value, {EV_MS} AS ms FROM events),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 86400000 + 1 AS k FROM e)
SELECT CAST(user_id AS VARCHAR) || '__24h_' || CAST(k AS VARCHAR) AS schema_identifier,
       count(*) AS n_tuples, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id, value) AS ids
FROM b GROUP BY user_id, k
""")
def nest_array_q(spark, sf):
    docs = extract_definition(table(spark, sf, "events"), d({
        KEY: "user_id",
        "activity": {"a": "nested_array", "a_id": "event_id", "value": "value"},
        "partition": {"interval": "24h", "ts_field": "ts"}}))
    return docs.select(KEY, F.size("activity").cast("long").alias("n_tuples"),
                       ids(F.col("activity"), lambda t: t[0]).alias("ids"))


@query("nest_top_array", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS schema_identifier, count(*) AS n_lines,
       string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS parts,
       'a_id,part,qty' AS line_cols
FROM l GROUP BY l_orderkey
""")
def nest_top_array(spark, sf):
    docs = extract_definition(shapes.orders_file(spark, sf), d({
        KEY: "o_orderkey",
        "lines": {"a": "nested_array", "a_id": "lines/l_linenumber", "part": "lines/l_partkey",
                  "qty": "lines/l_quantity"}}))
    return docs.select(KEY, F.size("lines").cast("long").alias("n_lines"),
                       ids(F.col("lines"), lambda t: t[1]).alias("parts"),
                       F.array_join("lines_cols", ",").alias("line_cols"))


@query("nest_collection", """
WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000 AS ms FROM orders),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 2592000000 + 1 AS k FROM o)
SELECT CAST(o_custkey AS VARCHAR) || '__720h_' || CAST(k AS VARCHAR) AS schema_identifier, count(*) AS n_orders,
       min(o_orderkey) AS first_order, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys
FROM b GROUP BY o_custkey, k
""")
def nest_collection_q(spark, sf):
    # a customer's orders per 30-day slice: the slice bounds the document even for a customer holding a
    # large share of all orders (its orders spread over every slice it ordered in)
    docs = extract_definition(table(spark, sf, "orders"), d({
        KEY: "o_custkey",
        "orders": {"a": "nested_collection", "n_id": "o_orderkey", "status": "o_orderstatus",
                   "priority": "o_orderpriority"},
        "partition": {"interval": "720h", "ts_field": "o_orderdate"}}))
    return docs.select(KEY, F.size("orders").cast("long").alias("n_orders"),
                       F.col("orders")[0].n_id.alias("first_order"),
                       ids(F.col("orders"), lambda o: o.n_id).alias("order_keys"))


@query("nest_two_level", f"""
WITH e AS (SELECT event_type, user_id, event_id, value, {EV_MS} AS ms FROM events),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 86400000 + 1 AS k FROM e)
SELECT CAST(user_id AS VARCHAR) || '__24h_' || CAST(k AS VARCHAR) AS schema_identifier, count(DISTINCT event_type) AS n_kinds,
       count(*) AS n_tuples, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_type, event_id, value) AS event_ids
FROM b GROUP BY user_id, k
""")
def nest_two_level(spark, sf):
    docs = extract_definition(table(spark, sf, "events"), d({
        KEY: "user_id",
        "sections": {"a": "nested_collection", "n_id": "event_type",
                     "members": {"a": "nested_array", "a_id": "event_id", "v": "value"}},
        "partition": {"interval": "24h", "ts_field": "ts"}}))
    tuples = F.flatten(F.transform("sections", lambda s: s.members))
    return docs.select(KEY, F.size("sections").cast("long").alias("n_kinds"), F.size(tuples).cast("long").alias("n_tuples"),
                       ids(tuples, lambda t: t[0]).alias("event_ids"))


@query("array_cols_index", """
WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000 AS ms FROM orders),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 2592000000 + 1 AS k FROM o)
SELECT CAST(o_custkey AS VARCHAR) || '__720h_' || CAST(k AS VARCHAR) AS schema_identifier, count(*) AS n_members,
       'a_id,status' AS members_cols, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS keys
FROM b GROUP BY o_custkey, k
""")
def array_cols_index(spark, sf):
    docs = extract_definition(table(spark, sf, "orders"), d({
        KEY: "o_custkey", "members": {"a": "nested_array", "a_id": "o_orderkey", "status": "o_orderstatus"},
        "partition": {"interval": "720h", "ts_field": "o_orderdate"}}))
    return docs.select(KEY, F.size("members").cast("long").alias("n_members"), F.array_join("members_cols", ",").alias("members_cols"),
                       ids(F.col("members"), lambda t: t[0]).alias("keys"))


@query("group_documents", """
SELECT c_nationkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS document
FROM customer
""")
def group_documents(spark, sf):
    return nest.group_documents(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey")


@query("expand_tuples", """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS schema_identifier, CAST(l_linenumber AS BIGINT) AS a_id,
       l_partkey AS part, l_quantity AS qty
FROM lineitem
""")
def expand_tuples(spark, sf):
    docs = extract_definition(shapes.orders_file(spark, sf), d({
        KEY: "o_orderkey",
        "lines": {"a": "nested_array", "a_id": "lines/l_linenumber", "part": "lines/l_partkey",
                  "qty": "lines/l_quantity"}}))
    rows = nest.expand_tuples(docs, "lines", ["a_id", "part", "qty"], keep=[KEY])
    return rows.select(KEY, long("a_id").alias("a_id"), long("part").alias("part"), F.col("qty").alias("qty"))


# ---------------------------------------------------------------- T: time


@query("time_bounds", f"SELECT min({EV_MS}) AS min_ms, max({EV_MS}) AS max_ms FROM events")
def time_bounds(spark, sf):
    e = timeparts.normalize_ts(table(spark, sf, "events"), "ts", out="ts_ms")
    return timeparts.time_bounds(e, "ts_ms")


@query("normalize_ts", f"""
SELECT event_id, {EV_MS} AS ts_ms, {EV_MS} AS ts_ms_from_text, {EV_MS} AS ts_ms_from_number FROM events
""")
def normalize_ts(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "ts",
        F.date_format("ts", shapes.XML_TS_WRITE).alias("ts_text"),
        shapes.epoch_ms("ts").cast("string").alias("ts_number_text"))
    e = timeparts.normalize_ts(e, "ts", out="ts_ms")
    e = timeparts.normalize_ts(e, "ts_text", fmt=shapes.XML_TS, out="ts_ms_from_text")
    e = timeparts.normalize_ts(e, "ts_number_text", fmt="ms", out="ts_ms_from_number")
    return e.select("event_id", "ts_ms", "ts_ms_from_text", "ts_ms_from_number")


_EV_BUCKET = f"""
WITH e AS (SELECT *, {EV_MS} AS ms FROM events),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 21600000 + 1 AS k FROM e)
"""


@query("time_partition", _EV_BUCKET + """
SELECT k AS slice, count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms FROM b GROUP BY k
""")
def time_partition(spark, sf):
    e = timeparts.normalize_ts(table(spark, sf, "events"), "ts", out="ts_ms")
    p = timeparts.assign_partition(e, "ts_ms", 6 * 3600 * 1000, bucket="slice")
    return p.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("min_ms"),
                                  F.max("ts_ms").alias("max_ms"))


@query("time_partition_legacy", _EV_BUCKET + """
SELECT k AS slice, count(*) AS n FROM b
WHERE k <= (SELECT CAST(ceil((max(ms) - min(ms)) / 21600000.0) AS BIGINT) FROM e)
GROUP BY k
""")
def time_partition_legacy(spark, sf):
    e = timeparts.normalize_ts(table(spark, sf, "events"), "ts", out="ts_ms")
    p = timeparts.assign_partition(e, "ts_ms", 6 * 3600 * 1000, tail="drop", bucket="slice")
    return p.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("partition_suffix", _EV_BUCKET + """
SELECT CAST(user_id AS VARCHAR) || '__6h_' || CAST(k AS VARCHAR) AS schema_identifier, count(*) AS n
FROM b GROUP BY user_id, k
""")
def partition_suffix(spark, sf):
    e = timeparts.normalize_ts(table(spark, sf, "events"), "ts", out="ts_ms")
    p = timeparts.assign_partition(e, "ts_ms", 6 * 3600 * 1000)
    keyed = p.select(timeparts.partition_suffix(F.col("user_id"), F.col("__bucket"), "6h").alias(KEY))
    return keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


@query("partition_count", f"""
SELECT (max({EV_MS}) - min({EV_MS})) // 21600000 + 1 AS n_slices,
       CAST(ceil((max({EV_MS}) - min({EV_MS})) / 21600000.0) AS BIGINT) AS n_slices_legacy
FROM events
""")
def partition_count(spark, sf):
    e = timeparts.normalize_ts(table(spark, sf, "events"), "ts", out="ts_ms")
    return timeparts.partition_count(e, "ts_ms", 6 * 3600 * 1000)


@query("partition_nest", f"""
WITH e AS (SELECT *, {EV_MS} AS ms FROM events),
     b AS (SELECT *, (ms - min(ms) OVER ()) // 86400000 + 1 AS k FROM e)
SELECT CAST(user_id AS VARCHAR) || '__24h_' || CAST(k AS VARCHAR) AS schema_identifier, count(DISTINCT event_id) AS n_moments,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS moment_ids
FROM b GROUP BY user_id, k
""")
def partition_nest(spark, sf):
    docs = extract_definition(table(spark, sf, "events"), d({
        KEY: "user_id",
        "moments": {"a": "nested_collection", "n_id": "event_id", "kind": "event_type"},
        "partition": {"interval": "24h", "ts_field": "ts"}}))
    return docs.select(KEY, F.size("moments").cast("long").alias("n_moments"),
                       ids(F.col("moments"), lambda m: m.n_id).alias("moment_ids"))


# ---------------------------------------------------------------- O: set operations


@query("union_definitions", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name, c_mktsegment AS segment,
       CAST(NULL AS DOUBLE) AS balance
FROM customer
UNION ALL
SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, s_acctbal FROM supplier
""")
def union_definitions_q(spark, sf):
    a = extract_definition(table(spark, sf, "customer"), d({KEY: "c_custkey", "name": "c_name",
                                                            "segment": "c_mktsegment"}))
    b = extract_definition(table(spark, sf, "supplier"), d({KEY: "s_suppkey", "name": "s_name",
                                                            "balance": "s_acctbal"}))
    return union_definitions([a, b]).select(KEY, "name", "segment", "balance")


# ---------------------------------------------------------------- J/K: upsert and store writes
# STORE: Participants made from every supplier; BATCH: Participants made from every customer. Keys
# overlap where c_custkey = s_suppkey (UPDATE), the rest are CREATE.


def store_docs(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias(KEY), F.col("s_name").alias("name"),
                    long("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
                    F.lit("supplier").alias("kind"),
                    F.struct(long("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).alias("info"))


def batch_docs(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias(KEY), F.col("c_name").alias("name"),
                    long("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
                    F.lit(None).cast("string").alias("kind"),
                    F.struct(long("c_nationkey").alias("nation"),
                             F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")).alias("info"))


def supplier_store(spark, sf) -> CollectionStore:
    store = CollectionStore(spark, scratch_path(spark, "store"))
    store.initialize("Participants", store_docs(spark, sf))
    return store


_UPSERT_FROM = "FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey"
_OP_SQL = "CASE WHEN s.s_suppkey IS NULL THEN 'CREATE' ELSE 'UPDATE' END"


@query("upsert_classify", f"SELECT CAST(c.c_custkey AS VARCHAR) AS schema_identifier, {_OP_SQL} AS op {_UPSERT_FROM}")
def upsert_classify(spark, sf):
    store = supplier_store(spark, sf)
    plan = upsert.plan_upsert(batch_docs(spark, sf), store.scan("Participants"), "Participants")
    return plan.select(KEY, "op")


@query("upsert_merge", f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS schema_identifier, {_OP_SQL} AS op, c.c_name AS name,
       CAST(c.c_nationkey AS BIGINT) AS nation, c.c_acctbal AS balance,
       CASE WHEN c.c_mktsegment <> 'BUILDING' THEN c.c_mktsegment END AS segment,
       CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' END AS kind,
       CAST(c.c_nationkey AS BIGINT) AS info_nation,
       COALESCE(CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END, s.s_acctbal) AS info_balance
{_UPSERT_FROM}
""")
def upsert_merge(spark, sf):
    store = supplier_store(spark, sf)
    plan = upsert.plan_upsert(batch_docs(spark, sf), store.scan("Participants"), "Participants")
    return plan.select(KEY, "op", "name", "nation", "balance", "segment", "kind",
                       F.col("info.nation").alias("info_nation"), F.col("info.balance").alias("info_balance"))


@query("batch_duplicates", """
SELECT CAST(k AS VARCHAR) AS schema_identifier, count(*) AS n
FROM (SELECT c_custkey AS k FROM customer
      UNION ALL SELECT o_custkey FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
GROUP BY k HAVING count(*) > 1
""")
def batch_duplicates(spark, sf):
    priorities = extract_definition(table(spark, sf, "orders"), d({KEY: "o_custkey", "priority": "o_orderpriority"}))
    incoming = union_definitions([batch_docs(spark, sf), priorities])
    return upsert.batch_duplicates(incoming).select(KEY, long("n").alias("n"))


@query("merge_widened_struct", """
SELECT CAST(COALESCE(c_custkey, s_suppkey) AS VARCHAR) AS schema_identifier,
       CAST(COALESCE(c_nationkey, s_nationkey) AS BIGINT) AS info_nation, c_acctbal AS info_balance
FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey
""")
def merge_widened_struct(spark, sf):
    store = CollectionStore(spark, scratch_path(spark, "store"))
    store.initialize("Participants", store_docs(spark, sf).select(KEY, F.struct(F.col("nation").cast("int").alias("nation")).alias("info")))
    batch = batch_docs(spark, sf).select(KEY, F.struct("nation", "balance").alias("info"))
    stored = store.scan("Participants")
    version, _ = upsert.apply_plan(upsert.plan_upsert(batch, stored, "Participants"), stored, "Participants")
    out = store.scan("Participants", version=store.write_version("Participants", version, 1))
    return out.select(KEY, F.col("info.nation").alias("info_nation"), F.col("info.balance").alias("info_balance"))


def order_lines_store(spark, sf) -> tuple[CollectionStore, DataFrame]:
    """Stored: every order with its lines. Incoming: the orders with returned lines, these lines only."""
    o = shapes.orders_file(spark, sf)
    store = CollectionStore(spark, scratch_path(spark, "store"))
    store.initialize("Orders", o.select(F.col("o_orderkey").cast("string").alias(KEY), "lines"))
    return store, o.filter(F.size("returns") > 0).select(F.col("o_orderkey").cast("string").alias(KEY),
                                                         F.col("returns").alias("lines"))


_LINES_SQL = """
WITH l AS (SELECT l_orderkey, max(l_returnflag = 'R') AS any_r,
                  string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS all_parts,
                  string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)
                    FILTER (l_returnflag = 'R') AS r_parts
           FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS schema_identifier, COALESCE(CASE WHEN any_r THEN r_parts ELSE all_parts END, '') AS parts,
       CASE WHEN any_r THEN '{hit}' ELSE 'kept' END AS status
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
"""


def _line_parts(store, version, status) -> DataFrame:
    docs = store.scan("Orders", version=version).select(KEY, ids(F.col("lines"), lambda x: x.l_partkey).alias("parts"))
    return docs.join(status.select(KEY, "status"), KEY, "left").fillna("kept", ["status"])


@query("merge_nested_arrays", _LINES_SQL.replace("{hit}", "UPDATED"))
def merge_nested_arrays(spark, sf):
    store, incoming = order_lines_store(spark, sf)
    stored = store.scan("Orders")
    version, outcome = upsert.apply_plan(upsert.plan_upsert(incoming, stored, "Orders"), stored, "Orders")
    return _line_parts(store, store.write_version("Orders", version, 1), outcome)


@query("replace_with_arrays", _LINES_SQL.replace("{hit}", "REPLACED"))
def replace_with_arrays(spark, sf):
    store, incoming = order_lines_store(spark, sf)
    version, status = upsert.replace_by_key(store.scan("Orders"), incoming, "Orders", overwrite=True)
    return _line_parts(store, store.write_version("Orders", version, 1), status)


@query("second_writer", """
SELECT CAST(s_suppkey AS VARCHAR) AS schema_identifier,
       CASE WHEN s_acctbal < 0 THEN s_name || ' (first)' ELSE s_name END AS name,
       CASE WHEN s_nationkey < 10 THEN 'second' ELSE 'supplier' END AS kind, TRUE AS refused
FROM supplier
""")
def second_writer(spark, sf):
    """Two applies made from one base version: the second is refused, and applied again it keeps both changes."""
    store = supplier_store(spark, sf)
    base = store.current_version("Participants")

    def version(change: DataFrame) -> DataFrame:
        now = store.scan("Participants")
        return upsert.apply_plan(upsert.plan_upsert(change, now, "Participants"), now, "Participants")[0]

    s = store_docs(spark, sf)
    first = s.filter("balance < 0").select(KEY, F.concat("name", F.lit(" (first)")).alias("name"))
    second = s.filter("nation < 10").select(KEY, F.lit("second").alias("kind"))
    one, two = version(first), version(second)
    store.write_version("Participants", one, base)
    try:
        store.write_version("Participants", two, base)
        refused = False
    except VersionConflict:
        refused = True
        store.write_version("Participants", version(second), base + 1)
    return store.scan("Participants").select(KEY, "name", "kind", F.lit(refused).alias("refused"))


def _apply(spark, sf, concurrent: bool = False):
    """Plan BATCH against STORE, stage it, optionally let a concurrent writer touch the store, apply."""
    store = supplier_store(spark, sf)
    plan = upsert.plan_upsert(batch_docs(spark, sf), store.scan("Participants"), "Participants")
    plan = stage_plan(plan, scratch_path(spark, "staged"))
    if concurrent:
        # another import renames the suppliers with a negative balance after our plan was made
        cur = store.scan("Participants")
        renamed = cur.filter(F.col("balance") < 0).select(KEY, F.concat("name", F.lit(" (renamed)")).alias("name"))
        p2 = upsert.plan_upsert(renamed, cur, "Participants")
        v2, _ = upsert.apply_plan(p2, cur, "Participants")
        store.write_version("Participants", v2)
    version, outcome = upsert.apply_plan(plan, store.scan("Participants"), "Participants")
    return store, version, outcome


@query("upsert_apply", """
SELECT CAST(COALESCE(c.c_custkey, s.s_suppkey) AS VARCHAR) AS schema_identifier,
       COALESCE(c.c_name, s.s_name) AS name, CAST(COALESCE(c.c_nationkey, s.s_nationkey) AS BIGINT) AS nation,
       COALESCE(c.c_acctbal, s.s_acctbal) AS balance,
       CASE WHEN c.c_mktsegment <> 'BUILDING' THEN c.c_mktsegment END AS segment,
       CASE WHEN s.s_suppkey IS NOT NULL THEN 'supplier' END AS kind,
       substr(sha256('Participants|' || CAST(COALESCE(c.c_custkey, s.s_suppkey) AS VARCHAR)), 1, 24) AS _id
FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey
""")
def upsert_apply(spark, sf):
    store, version, _ = _apply(spark, sf)
    v = store.write_version("Participants", version)
    return store.scan("Participants", version=v).select(KEY, "name", "nation", "balance", "segment", "kind", "_id")


@query("apply_creates", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, 'CREATED' AS status
FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def apply_creates(spark, sf):
    _, _, outcome = _apply(spark, sf)
    return outcome.filter(F.col("status") == upsert.CREATED).select(KEY, "status")


@query("apply_updates", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, 'UPDATED' AS status
FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE s_acctbal >= 0
""")
def apply_updates(spark, sf):
    _, _, outcome = _apply(spark, sf, concurrent=True)
    return outcome.filter(F.col("status") == upsert.UPDATED).select(KEY, "status")


@query("etag_conflicts", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, 'CONFLICT' AS status, s_name || ' (renamed)' AS stored_name
FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE s_acctbal < 0
""")
def etag_conflicts(spark, sf):
    _, version, outcome = _apply(spark, sf, concurrent=True)
    conflicts = outcome.filter(F.col("status") == upsert.CONFLICT).select(KEY, "status")
    return conflicts.join(version.select(KEY, F.col("name").alias("stored_name")), KEY, "left")


@query("replace_by_key", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier,
       CASE WHEN s_suppkey IS NULL THEN 'CREATED' ELSE 'REPLACED' END AS status,
       c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS kind
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def replace_by_key(spark, sf):
    store = supplier_store(spark, sf)
    incoming = batch_docs(spark, sf).drop("kind")
    version, status = upsert.replace_by_key(store.scan("Participants"), incoming, "Participants", overwrite=True)
    v = store.write_version("Participants", version)
    # whole-row replacement: the stored `kind` of a replaced supplier does not survive
    stored = store.scan("Participants", version=v).select(KEY, "name", "nation", "kind")
    return status.join(stored, KEY, "left").select(KEY, "status", "name", "nation", "kind")


@query("delete_by_key", """
SELECT CAST(s_suppkey AS VARCHAR) AS schema_identifier, s_name AS name
FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def delete_by_key(spark, sf):
    store = supplier_store(spark, sf)
    keys = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey")
    remaining = upsert.delete_by_key(store.scan("Participants"), keys)
    v = store.write_version("Participants", remaining)
    return store.scan("Participants", version=v).select(KEY, "name")


@query("staged_plan", f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS schema_identifier, {_OP_SQL} AS op, c.c_name AS name {_UPSERT_FROM}
""")
def staged_plan(spark, sf):
    store = supplier_store(spark, sf)
    plan = upsert.plan_upsert(batch_docs(spark, sf), store.scan("Participants"), "Participants")
    return stage_plan(plan, scratch_path(spark, "staged")).select(KEY, "op", "name")


# ---------------------------------------------------------------- R: reports


@query("import_counts", """
SELECT 'Participants' AS collection, CASE WHEN s.s_suppkey IS NULL THEN 'CREATE' ELSE 'UPDATE' END AS op,
       count(*) AS n
FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey GROUP BY 2
UNION ALL SELECT 'Teams', 'CREATE', count(*) FROM nation
UNION ALL SELECT 'Games', 'CREATE', count(*) FROM orders
""")
def import_counts_q(spark, sf):
    store = supplier_store(spark, sf)
    p1 = upsert.plan_upsert(batch_docs(spark, sf), store.scan("Participants"), "Participants")
    teams = extract_definition(table(spark, sf, "nation"), d({KEY: "n_nationkey", "name": "n_name"}))
    games = extract_definition(table(spark, sf, "orders"), d({KEY: "o_orderkey", "home_team_id": "o_custkey"}))
    p2 = upsert.plan_upsert(teams, store.scan("Teams"), "Teams")
    p3 = upsert.plan_upsert(games, store.scan("Games"), "Games")
    return import_counts([p1, p2, p3]).select("collection", "op", long("n").alias("n"))


@query("import_outcome", """
WITH o AS (SELECT CASE WHEN s_suppkey IS NULL THEN 'CREATE' ELSE 'UPDATE' END AS op,
                  CASE WHEN s_suppkey IS NULL THEN 'CREATED' WHEN s_acctbal >= 0 THEN 'UPDATED' ELSE 'CONFLICT' END AS status
           FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)
SELECT 'Participants' AS collection, op, status, count(*) AS n,
       CASE status WHEN 'CREATED' THEN printf('Created %d new documents', count(*))
                   WHEN 'UPDATED' THEN printf('Updated %d documents', count(*))
                   ELSE printf('%d documents not applied: %s', count(*), status) END AS message
FROM o GROUP BY op, status
""")
def import_outcome_q(spark, sf):
    _, _, outcome = _apply(spark, sf, concurrent=True)
    return import_outcome(outcome).select("collection", "op", "status", long("n").alias("n"), "message")


@query("provenance_columns", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, c_name AS name, 'analyst' AS import_author,
       'initial load' AS import_message, 'customer.csv' AS import_file, 'customer_mapping' AS import_mapping,
       'csv' AS import_format
FROM customer
""")
def provenance_columns(spark, sf):
    docs = extract_definition(table(spark, sf, "customer"), d({KEY: "c_custkey", "name": "c_name"}))
    return with_provenance(docs, "analyst", "initial load", "customer.csv", "customer_mapping", "csv")


# ---------------------------------------------------------------- K1: documents


@query("to_documents", """
SELECT CAST(c_custkey AS VARCHAR) AS schema_identifier, CAST(c_custkey AS BIGINT) AS c_custkey, c_name,
       CAST(c_nationkey AS BIGINT) AS c_nationkey, length(c_name) + 0 AS name_len
FROM customer
""")
def to_documents(spark, sf):
    c = table(spark, sf, "customer").withColumn(KEY, F.col("c_custkey").cast("string"))
    docs = nest.to_documents(c)
    back = docs.select(KEY, F.from_json("document", "c_custkey bigint, c_name string, c_nationkey bigint").alias("d"))
    return back.select(KEY, "d.c_custkey", "d.c_name", "d.c_nationkey", F.length("d.c_name").cast("long").alias("name_len"))


@query("merge_wide_numbers", """
WITH c AS (SELECT c_custkey, c_nationkey + 0.5 AS small, c_custkey % 2 = 0 AS bad FROM customer)
SELECT CAST(COALESCE(s_suppkey, c_custkey) AS VARCHAR) AS schema_identifier,
       CASE WHEN c_custkey IS NOT NULL AND NOT bad THEN 3 ELSE 9007199254740992 + s_suppkey END AS big,
       CASE WHEN c_custkey IS NOT NULL AND NOT bad THEN CAST(small AS DOUBLE) ELSE CAST(s_nationkey AS DOUBLE) END AS small,
       CASE WHEN c_custkey IS NULL THEN 'kept' WHEN bad THEN 'REJECTED' WHEN s_suppkey IS NULL THEN 'CREATED' ELSE 'UPDATED' END AS status,
       s_suppkey IS NOT NULL AND (c_custkey IS NULL OR bad) AS same_tag
FROM supplier FULL OUTER JOIN c ON s_suppkey = c_custkey
WHERE s_suppkey IS NOT NULL OR NOT bad
""")
def merge_wide_numbers(spark, sf):
    """Doubles meet stored longs. ``big`` holds longs that no double has, so it stays long and a fraction is rejected;
    ``small`` widens. Documents outside the batch keep value and tag."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    store.initialize("Wide", s.select(F.col("s_suppkey").cast("string").alias(KEY), (F.lit(9007199254740992) + long("s_suppkey")).alias("big"),
                                      long("s_nationkey").alias("small")))
    batch = c.select(F.col("c_custkey").cast("string").alias(KEY), F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(3.0).alias("big"),
                     (F.col("c_nationkey") + F.lit(0.5)).cast("double").alias("small"))
    stored = store.scan("Wide")
    version, outcome = upsert.apply_plan(upsert.plan_upsert(batch, stored, "Wide"), stored, "Wide")
    now = store.scan("Wide", version=store.write_version("Wide", version, 1))
    tags = stored.select(F.col(KEY).alias("k"), F.col("_etag").alias("before"))
    out = now.join(tags, F.col(KEY) == F.col("k"), "left").join(outcome.select(KEY, "status"), KEY, "left")
    return out.select(KEY, "big", "small", F.coalesce("status", F.lit("kept")).alias("status"),
                      F.coalesce(F.col("before") == F.col("_etag"), F.lit(False)).alias("same_tag"))


@query("nest_parts", f"""
SELECT event_type AS part_of, count(*) AS n_members, CAST(sum(event_id) AS BIGINT) AS id_sum, TRUE AS bounded FROM events GROUP BY event_type
UNION ALL SELECT 'all', count(*), CAST(sum(event_id) AS BIGINT), TRUE FROM events
""")
def nest_parts(spark, sf):
    """Events nested under a constant key and under a few hot ones, split into parts of about 400 rows and united."""
    out = []
    for key in ("dshs#mapping_all", "event_type"):
        one = d({KEY: key, "samples": {"a": "nested_collection", "n_id": "event_id", "reading": "value"}, "parts": {"rows": 400}})
        docs = extract_definition(table(spark, sf, "events"), one)
        ids_of = F.aggregate("samples", F.lit(0).cast("long"), lambda acc, x: acc + x.n_id)
        out.append(docs.groupBy("part_of").agg(long(F.sum(F.size("samples"))).alias("n_members"), long(F.sum(ids_of)).alias("id_sum"),
                                               (F.max(F.size("samples")) <= 800).alias("bounded")))
    return union_definitions(out)


# ---------------------------------------------------------------- E: whole imports

BROKEN_MAPPING = {
    "name": "broken_feed",
    "file": {"format": "csv", "delimiter": ";", "header": "True", "timestamp_format": "ms"},
    "data": {"Items": [{"a": "collection", KEY: "id", "x": "x"}],
             "Names": [{"a": "collection", KEY: "name"}],
             "Feeds": [{"a": "collection", KEY: "dshs#mapping_broken"}]},
}


def _broken_sql(variant: str, case: str, bad: str, keyless: str, more: str) -> str:
    return f"""
SELECT '{variant}' AS variant, '(source)' AS collection, 'MALFORMED' AS reason, {bad} AS text, count(*) AS n
FROM customer WHERE {case} GROUP BY ALL
UNION ALL SELECT '{variant}', 'Items', 'NO_KEY', {keyless}, count(*) FROM customer WHERE c_custkey % 7 = 5 GROUP BY ALL
UNION ALL SELECT '{variant}', 'Items', 'stored', NULL, count(*) FROM customer WHERE NOT ({case}) AND c_custkey % 7 <> 5
{more}"""


_BROKEN_JSON = ("c_custkey % 7 IN (3, 4)", """CASE WHEN c_custkey % 7 = 3 THEN '{"id":"' || c_custkey || '","x' ELSE '{"id":' END""",
                """'{"x":0}'""")
_BROKEN_CSV = ("c_custkey % 7 IN (3, 4, 6)", """CASE c_custkey % 7 WHEN 3 THEN c_custkey || ';1;n;extra' WHEN 4 THEN c_custkey || ';1'
  ELSE '"' || c_custkey || ';1;n' END""", """'{"x":' || c_nationkey || ',"name":"' || c_name || '"}'""")
_JSON_MORE = """UNION ALL SELECT '{v}', 'Names', 'NO_KEY', '{{"x":0}}', count(*) FROM customer WHERE c_custkey % 7 = 5
UNION ALL SELECT '{v}', 'Names', 'stored', NULL, count(*) FROM customer WHERE c_custkey % 7 NOT IN (3, 4, 5)
UNION ALL SELECT '{v}', 'Feeds', 'stored', NULL, 1"""
_CSV_MORE = """UNION ALL SELECT '{v}', 'Names', 'stored', NULL, count(*) FROM customer WHERE c_custkey % 7 NOT IN (3, 4, 6)
UNION ALL SELECT '{v}', 'Feeds', 'stored', NULL, 1"""


@query("rejected_records", " UNION ALL ".join(
    _broken_sql(f"{fmt} {how}", *parts, "" if how == "one" else more.format(v=f"{fmt} {how}"))
    for fmt, parts, more in (("json", _BROKEN_JSON, _JSON_MORE), ("csv", _BROKEN_CSV, _CSV_MORE))
    for how in ("one", "three", "unstaged")))
def rejected_records(spark, sf):
    """Feeds with planted broken lines: every line is a document or one reject with its text and file, whether one
    definition reads the feed or three, and whether the feed is staged or parsed in every pass."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("x"),
                                            "c_name")
    rest = F.col("c_custkey") % 7
    json = F.when(rest == 3, F.format_string('{"id":"%s","x', "k")).when(rest == 4, '{"id":').when(rest == 5, '{"x":0}').otherwise(
        F.format_string('{"id":"%s","x":%s,"name":"%s"}', "k", "x", "c_name"))
    csv = F.when(rest == 3, F.concat("k", F.lit(";1;n;extra"))).when(rest == 4, F.concat("k", F.lit(";1"))).when(
        rest == 5, F.concat(F.lit(";"), "x", F.lit(";"), "c_name")).when(rest == 6, F.concat(F.lit('"'), "k", F.lit(";1;n"))).otherwise(
        F.concat_ws(";", "k", "x", "c_name"))
    head = spark.range(1).select(F.lit("id;x;name").alias("value"))
    # one file, so that its first line is the header
    paths = {"json": shapes.write(c.select(json.alias("value")), "text", "broken-json", sf),
             "csv": shapes.write(head.unionByName(c.select(csv.alias("value"))).coalesce(1), "text", "broken-csv", sf)}
    out = []
    for fmt, path in paths.items():
        for how in ("one", "three", "unstaged"):
            data = {k: v for k, v in BROKEN_MAPPING["data"].items() if k == "Items" or how != "one"}
            mapping = dict(BROKEN_MAPPING, file=dict(BROKEN_MAPPING["file"], format=fmt), data=data)
            store = CollectionStore(spark, scratch_path(spark, "store"))
            ip, outcome = ingest(spark, mapping, path, store, stage_source=how != "unstaged")
            none = F.lit(None).cast("string")
            left = ip.rejects().filter(F.col("file").contains(f"broken-{fmt}"))
            rows = left.groupBy("collection", "reason", "text").agg(F.count(F.lit(1)).alias("n")).unionByName(
                outcome.filter("status = 'CREATED'").select("collection", F.lit("stored").alias("reason"), none.alias("text"), "n"))
            out.append(rows.withColumn("variant", F.lit(f"{fmt} {how}")))
    return union_definitions(out)


EVENTS_MAPPING = {
    "name": "activity_log",
    "file": {"format": "csv", "delimiter": ";", "header": "True", "timestamp_format": "ms"},
    "data": {
        "Feeds": [{"a": "collection", KEY: "dshs#mapping_activity"}],
        "Users": [{"a": "collection", KEY: "user"}],
        "Kinds": [{"a": "collection", KEY: "kind"}],
        "Activity": [{
            "a": "collection", KEY: "user",
            "samples": {"a": "nested_collection", "n_id": "at ms",
                        "readings": {"a": "nested_array", "a_id": "event no", "reading": "reading", "step": "step"}},
            "partition": {"interval": "24h", "ts_field": "at ms"}}],
    },
}

#: Columns of an import's rows: what the store holds per document, then the outcome as reported.
_IMPORT = "collection, schema_identifier, n_items, n_tuples, total"


def import_rows(store: CollectionStore, outcome: DataFrame, nested: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Stored documents with their items, tuples and the floor sum of one tuple member; then the outcome's rows.

    ``nested``: collection -> (nested collection, its tuple array, position of the summed member).
    """
    none = F.lit(None).cast("long")
    parts = []
    for c in store.collections():
        docs = store.scan(c)
        if c in nested:
            items, tuples, at = nested[c]
            rows = F.flatten(F.transform(items, lambda m: m[tuples]))
            total = F.aggregate(rows, F.lit(0).cast("long"), lambda acc, t: acc + F.floor(t[at].cast("double")).cast("long"))
            cols = F.size(items).cast("long"), F.size(rows).cast("long"), total
        else:
            cols = F.lit(1).cast("long"), none, none
        parts.append(docs.select(F.lit(c).alias("collection"), KEY, *[x.alias(n) for x, n in zip(cols, ("n_items", "n_tuples", "total"))]))
    parts.append(outcome.select("collection", F.concat_ws(" ", "op", "status").alias(KEY), long("n").alias("n_items"),
                                none.alias("n_tuples"), none.alias("total")))
    return union_definitions(parts)


ACTIVITY = {"Activity": ("samples", "readings", 1)}


def ingest_flat_from(spark: SparkSession, sf: str) -> DataFrame:
    store = CollectionStore(spark, scratch_path(spark, "store"))
    _, outcome = ingest(spark, EVENTS_MAPPING, shapes.events_csv(spark, sf), store)
    return import_rows(store, outcome, ACTIVITY)


def _activity_sql(prefix: str, feed: str) -> str:
    """Rows of the four collections; ``prefix`` of user keys."""
    return f"""
docs AS (
  SELECT 'Feeds' AS collection, '{feed}' AS schema_identifier, 1 AS n_items, CAST(NULL AS BIGINT) AS n_tuples,
         CAST(NULL AS BIGINT) AS total FROM (SELECT 1 FROM events LIMIT 1)
  UNION ALL SELECT DISTINCT 'Users', '{prefix}' || CAST(user_id AS VARCHAR), 1, NULL, NULL FROM events
  UNION ALL SELECT DISTINCT 'Kinds', event_type, 1, NULL, NULL FROM events
  UNION ALL
  SELECT 'Activity', '{prefix}' || CAST(user_id AS VARCHAR) || '__24h_' || CAST(s AS VARCHAR), count(DISTINCT ms), count(*),
         CAST(sum(floor(value)) AS BIGINT)
  FROM (SELECT *, (ms - min(ms) OVER ()) // 86400000 + 1 AS s FROM (SELECT *, {EV_MS} AS ms FROM events)) GROUP BY user_id, s)"""


def _created_sql(prefix: str, feed: str) -> str:
    return f"""WITH {_activity_sql(prefix, feed)}
SELECT {_IMPORT} FROM docs
UNION ALL SELECT collection, 'CREATE CREATED', count(*), NULL, NULL FROM docs GROUP BY collection"""


@query("ingest_flat", _created_sql("", "activity"))
def ingest_flat(spark, sf):
    return ingest_flat_from(spark, sf)


def import_again(spark: SparkSession, mapping: dict, path: str) -> DataFrame:
    """Import the same file twice: the second outcome, and how many version tags it moved."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    ingest(spark, mapping, path, store)
    _, outcome = ingest(spark, mapping, path, store)
    parts = [outcome.select("collection", F.concat_ws(" ", "op", "status").alias("what"), long("n").alias("n"))]
    for c in store.collections():
        a, b = (store.scan(c, version=v).select(KEY, pack_hex(F.col("_etag")).alias(f"e{v}")) for v in (1, 2))
        both = a.join(b, KEY, "full").agg(F.count(F.when(~F.col("e1").eqNullSafe(F.col("e2")), 1)).alias("n"))
        # one collection after the other: their shuffles need not be on disk together
        both = stage_documents(both, scratch_path(spark, "moved"))
        parts.append(both.select(F.lit(c).alias("collection"), F.lit("tags moved").alias("what"), "n"))
    return union_definitions(parts)


def _again_sql(prefix: str, feed: str) -> str:
    return f"""WITH {_activity_sql(prefix, feed)}
SELECT collection, 'UPDATE UPDATED' AS what, count(*) AS n FROM docs GROUP BY collection
UNION ALL SELECT DISTINCT collection, 'tags moved', 0 FROM docs"""


@query("ingest_flat_again", _again_sql("", "activity"))
def ingest_flat_again(spark, sf):
    return import_again(spark, EVENTS_MAPPING, shapes.events_csv(spark, sf))


ORDERS_MAPPING = {
    "name": "orders_feed",
    "file": {"format": "json", "timestamp_format": "ms"},
    "data": {
        "Orders": [{"a": "collection", KEY: "o_orderkey", "placed": "o_ts_ms", "customer": "header.o_custkey"}],
        "Parties": [{"a": "collection", KEY: "header.o_custkey", "role": "dshs#mapping_customer"},
                    {"a": "collection", KEY: "lines/l_suppkey", "role": "dshs#mapping_supplier"}],
        "Purchases": [{
            "a": "collection", KEY: "header.o_custkey",
            "orders": {"a": "nested_collection", "n_id": "o_orderkey", "placed": "o_ts_ms",
                       "lines": {"a": "nested_array", "a_id": "lines/l_linenumber", "part": "lines/l_partkey",
                                 "qty": "lines/l_quantity"}},
            "partition": {"interval": "720h", "ts_field": "o_ts_ms"}}],
    },
}

_ORDERS_SQL = """
l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000 AS ms FROM orders
      WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
b AS (SELECT *, (ms - min(ms) OVER ()) // 2592000000 + 1 AS s FROM o),
docs AS (
  SELECT 'Orders' AS collection, CAST(o_orderkey AS VARCHAR) AS schema_identifier, 1 AS n_items,
         CAST(NULL AS BIGINT) AS n_tuples, CAST(NULL AS BIGINT) AS total FROM orders
  UNION ALL SELECT DISTINCT 'Parties', CAST(k AS VARCHAR), 1, NULL, NULL
  FROM (SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem)
  UNION ALL
  SELECT 'Purchases', CAST(o_custkey AS VARCHAR) || '__720h_' || CAST(s AS VARCHAR), count(DISTINCT o_orderkey), count(*),
         CAST(sum(l_partkey) AS BIGINT)
  FROM b JOIN l ON o_orderkey = l_orderkey GROUP BY o_custkey, s),
twice AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT l_suppkey FROM lineitem))"""


@query("ingest_nested", f"""WITH {_ORDERS_SQL}
SELECT {_IMPORT} FROM docs
UNION ALL SELECT collection, 'CREATE CREATED', count(*), NULL, NULL FROM docs GROUP BY collection
UNION ALL SELECT 'Parties', 'CREATE DUPLICATE', n, NULL, NULL FROM twice WHERE n > 0
""")
def ingest_nested(spark, sf):
    store = CollectionStore(spark, scratch_path(spark, "store"))
    _, outcome = ingest(spark, ORDERS_MAPPING, shapes.orders_json(spark, sf), store)
    return import_rows(store, outcome, {"Purchases": ("orders", "lines", 1)})


@query("ingest_nested_again", f"""WITH {_ORDERS_SQL}
SELECT collection, 'UPDATE UPDATED' AS what, count(*) AS n FROM docs GROUP BY collection
UNION ALL SELECT 'Parties', 'UPDATE DUPLICATE', n FROM twice WHERE n > 0
UNION ALL SELECT DISTINCT collection, 'tags moved', 0 FROM docs
""")
def ingest_nested_again(spark, sf):
    return import_again(spark, ORDERS_MAPPING, shapes.orders_json(spark, sf))


RECORDINGS_MAPPING = {
    "name": "recordings",
    "file": {"format": "xml", "rowTag": "Recording", "valueTag": "_text", "timestamp_format": shapes.XML_TS},
    "data": {
        "Feeds": [{"a": "collection", KEY: "dshs#mapping_recordings"}],
        "Users": [{"a": "collection", KEY: "Head._user"}],
        "Kinds": [{"a": "collection", KEY: "Track/_kind"}],
        "Activity": [{
            "a": "collection", KEY: "Head._user",
            "samples": {"a": "nested_collection", "n_id": "Track/Point/_ms",
                        "readings": {"a": "nested_array", "a_id": "Track/Point/_no", "reading": "Track/Point/_v",
                                     "step": "Track/Point/_k"}},
            "partition": {"interval": "24h", "ts_field": "Track/Point/_at"}}],
    },
}


@query("ingest_xml", _created_sql("U", "recordings"))
def ingest_xml(spark, sf):
    store = CollectionStore(spark, scratch_path(spark, "store"))
    _, outcome = ingest(spark, RECORDINGS_MAPPING, shapes.events_xml(spark, sf), store)
    return import_rows(store, outcome, ACTIVITY)


@query("ingest_xml_again", _again_sql("U", "recordings"))
def ingest_xml_again(spark, sf):
    return import_again(spark, RECORDINGS_MAPPING, shapes.events_xml(spark, sf))


@query("import_two_formats", f"""WITH {_activity_sql("", "activity")},
x AS (WITH {_activity_sql("U", "recordings")} SELECT * FROM docs),
both_ AS (SELECT * FROM docs UNION SELECT * FROM x)
SELECT {_IMPORT}, 'array<struct<n_id:bigint,readings:array<array<double>>>>' AS samples_type FROM both_
UNION ALL SELECT collection, CASE WHEN collection = 'Kinds' THEN 'UPDATE UPDATED' ELSE 'CREATE CREATED' END, count(*), NULL, NULL,
  'array<struct<n_id:bigint,readings:array<array<double>>>>' FROM x GROUP BY collection
""")
def import_two_formats(spark, sf):
    """A CSV log, then an XML log whose values all arrive as text: the stored element types stay what they were."""
    store = CollectionStore(spark, scratch_path(spark, "store"))
    ingest(spark, EVENTS_MAPPING, shapes.events_csv(spark, sf), store)
    _, outcome = ingest(spark, RECORDINGS_MAPPING, shapes.events_xml(spark, sf), store)
    kind = store.scan("Activity").schema["samples"].dataType.simpleString()
    return import_rows(store, outcome, ACTIVITY).withColumn("samples_type", F.lit(kind))


@query("import_xml_first", f"""WITH {_activity_sql("", "activity")},
x AS (WITH {_activity_sql("U", "recordings")} SELECT * FROM docs)
SELECT {_IMPORT}, 'array<struct<n_id:bigint,readings:array<array<double>>>>' AS samples_type, CAST(0 AS BIGINT) AS differing
FROM (SELECT * FROM docs UNION SELECT * FROM x)
""")
def import_xml_first(spark, sf):
    """An XML log, then a CSV log, and the other way round: same schema, same documents, numbers as numbers."""
    feeds = [(RECORDINGS_MAPPING, shapes.events_xml(spark, sf)), (EVENTS_MAPPING, shapes.events_csv(spark, sf))]
    stores = []
    for order in (feeds, feeds[::-1]):
        stores.append(CollectionStore(spark, scratch_path(spark, "store")))
        for mapping, path in order:
            ingest(spark, mapping, path, stores[-1])
    one, two = stores
    kind = one.scan("Activity").schema["samples"].dataType.simpleString()
    differing = []
    for c in one.collections():
        a, b = one.scan(c, system=False), two.scan(c, system=False)
        if {f.name: f.dataType.simpleString() for f in a.schema} != {f.name: f.dataType.simpleString() for f in b.schema}:
            raise AssertionError(f"{c}: {a.schema.simpleString()} and {b.schema.simpleString()}")
        # rows of one that the other does not have, both ways, each time they occur
        both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
        differing.append(both.groupBy(*a.columns).agg(F.abs(F.sum("__side")).alias("n")).select("n"))
    none = spark.createDataFrame([], "collection string, op string, status string, n long")
    total = union_definitions(differing)
    return import_rows(one, none, ACTIVITY).withColumns({
        "samples_type": F.lit(kind), "differing": total.select(F.coalesce(F.sum("n"), F.lit(0).cast("long"))).scalar()})

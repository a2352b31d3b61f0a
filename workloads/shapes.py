"""Provider-shaped sources derived from the driver tables, built with Spark and written under the shared
folder, so every registered query reads real files through the library's own readers and its work grows
with the tables.

Nesting follows natural parents bounded by time or by the order: an order holds its lines; a customer
row holds one month of its orders; an XML position row holds one (user, hour) recording. No key is
folded into one row whatever its share of the data. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmodel.functions.columns import ntz_epoch_ms
from trackmodel.session import freed_shuffles, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms(c: str):
    """Epoch milliseconds of a timestamp_ntz column read as UTC (floor, like ``epoch_us // 1000``)."""
    return ntz_epoch_ms(F.col(c))


_WRITTEN: dict[tuple, str] = {}


def write(df: DataFrame, fmt: str, name: str, sf_dir: str, **options) -> str:
    """Write ``df`` once per session and input folder (a provider file arrives once; queries share it)."""
    key = (df.sparkSession.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _WRITTEN:
        path = scratch_path(df.sparkSession, name)
        w = df.write.format(fmt)
        for k, v in options.items():
            w = w.option(k, v)
        with freed_shuffles(df.sparkSession):
            w.save(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def customer_csv(spark: SparkSession, sf_dir: str) -> str:
    return write(table(spark, sf_dir, "customer"), "csv", "customer-csv", sf_dir, header=True, sep=";")


def customer_xml(spark: SparkSession, sf_dir: str) -> str:
    return write(table(spark, sf_dir, "customer"), "xml", "customer-xml", sf_dir, rowTag="customer", rootTag="customers")


LINE_FIELDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]


def orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ON: one row per order; ``header`` struct (with a ``pair`` array), ``lines`` and ``returns`` arrays.

    ``lines`` holds every line of the order and ``returns`` the returned ones, each sorted by all
    fields; orders without lines get empty arrays.
    """
    li = table(spark, sf_dir, "lineitem")
    line = F.struct(*[F.col(c) for c in LINE_FIELDS])
    per_order = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    per_order = per_order.withColumn("returns", F.filter("lines", lambda x: x.l_returnflag == "R"))  # sorted as they are
    o = table(spark, sf_dir, "orders")
    return o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").select(
        "o_orderkey",
        epoch_ms("o_orderdate").alias("o_ts_ms"),
        F.struct("o_custkey", "o_orderstatus", "o_orderpriority",
                 F.array("o_orderkey", "o_custkey").alias("pair")).alias("header"),
        F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,"
                                            "l_quantity:double,l_returnflag:string>>")).alias("lines"),
        F.coalesce("returns", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,"
                                              "l_quantity:double,l_returnflag:string>>")).alias("returns"),
    )


def orders_json(spark: SparkSession, sf_dir: str) -> str:
    return write(orders_nested(spark, sf_dir), "json", "orders-json", sf_dir, compression="gzip", **{"zlib.compress.level": "BEST_SPEED"})


def orders_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ON as a nested Parquet file (types kept exactly), written once per session."""
    return spark.read.parquet(write(orders_nested(spark, sf_dir), "parquet", "orders-parquet", sf_dir))


def customer_orders(spark: SparkSession, sf_dir: str, via_struct: bool = False) -> DataFrame:
    """CO: one row per customer and order month with that month's ``orders`` (each with its ``lines``,
    or ``detail.lines`` when ``via_struct``). Customers without orders get one row with an empty list.

    The month bounds a row the way a provider bounds a file: a customer holding a third of all orders
    is spread over as many rows as it has months, never folded into one."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if via_struct:
        order = F.struct("o_orderkey", "o_orderstatus",
                         F.struct("o_orderpriority", "lines").alias("detail"))
    else:
        order = F.struct("o_orderkey", "o_orderstatus", "lines")
    month = F.date_format("o_orderdate", "yyyy-MM").alias("o_month")
    per_cust = o.groupBy("o_custkey", month).agg(F.sort_array(F.collect_list(order)).alias("orders"))
    c = table(spark, sf_dir, "customer")
    empty = per_cust.schema["orders"].dataType.simpleString()
    return c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left").select(
        "c_custkey", "c_name", "c_nationkey", "o_month", F.coalesce("orders", F.array().cast(empty)).alias("orders"))


def customer_orders_file(spark: SparkSession, sf_dir: str, via_struct: bool = False) -> DataFrame:
    """CO as a nested Parquet file, written once per session."""
    name = "customer-orders-detail" if via_struct else "customer-orders"
    return spark.read.parquet(write(customer_orders(spark, sf_dir, via_struct), "parquet", name, sf_dir))


def events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat activity log from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(epoch_ms("ts").alias("at ms"), F.col("event_id").alias("event no"), F.col("user_id").alias("user"),
                    F.col("event_type").alias("kind"), F.col("value").alias("reading"),
                    F.get_json_object("props", "$.k").cast("int").alias("step"))


def events_csv(spark: SparkSession, sf_dir: str) -> str:
    return write(events_flat(spark, sf_dir), "csv", "events-csv", sf_dir, header=True, sep=";")


XML_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
# the driver tables hold UTC wall-clock values (timestamp_ntz): written with a literal zone designator
XML_TS_WRITE = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def events_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``Recording`` row per (user, hour): a ``Head``, and a ``Track`` of ``Point``s per event type.

    The hour bounds a row, so a user holding a third of all events is spread over as many rows as it has hours."""
    e = table(spark, sf_dir, "events")
    point = F.struct(F.col("event_id").alias("_no"), epoch_ms("ts").alias("_ms"),
                     F.date_format("ts", XML_TS_WRITE).alias("_at"), F.col("value").alias("_v"),
                     F.get_json_object("props", "$.k").cast("int").alias("_k"))
    e = e.select("user_id", "event_type", F.date_format("ts", "yyyyMMddHH").alias("hour"), point.alias("point"))
    tracks = e.groupBy("user_id", "hour", "event_type").agg(F.sort_array(F.collect_list("point")).alias("Point"))
    rows = tracks.groupBy("user_id", "hour").agg(F.sort_array(F.collect_list(
        F.struct(F.col("event_type").alias("_kind"), "Point"))).alias("Track"))
    return rows.select(F.struct(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("_user"),
                                F.col("hour").alias("_hour")).alias("Head"), "Track")


def events_xml(spark: SparkSession, sf_dir: str) -> str:
    return write(events_recordings(spark, sf_dir), "xml", "recordings-xml", sf_dir, rowTag="Recording", rootTag="Log")

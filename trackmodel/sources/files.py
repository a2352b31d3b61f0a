"""Provider files -> DataFrames (CSV, JSON, XML), dispatched from a mapping's ``file`` block.

``read_source`` opens a file as Spark does. ``read_records`` is what an import reads: each record also says
which file it came from and, when it is broken, its text, so that it can be reported instead of lost.

Type inference costs one extra pass over the input; on large inputs pass ``schema`` (for instance the
schema inferred from one sample file) or a ``sampling_ratio`` so inference reads a fraction.
XML is read with leaf values as strings (the structure is still inferred): inference would turn ids
such as ``T1`` into timestamps. An import decides their types from the values (:mod:`trackmodel.sources.typed`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmodel.plans.mapping import FileSpec, parse_file_spec


def read_csv(spark: SparkSession, path: str | list[str], header: bool = True, delimiter: str = ",",
             schema: T.StructType | str | None = None, sampling_ratio: float | None = None) -> DataFrame:
    r = spark.read.option("header", header).option("sep", delimiter)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
        if sampling_ratio:
            r = r.option("samplingRatio", sampling_ratio)
    return r.csv(path)


def read_json(spark: SparkSession, path: str | list[str], multi_line: bool = False,
              schema: T.StructType | str | None = None, sampling_ratio: float | None = None) -> DataFrame:
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    elif sampling_ratio:
        r = r.option("samplingRatio", sampling_ratio)
    return r.json(path)


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str, value_tag: str | None = None,
             infer_leaf_types: bool = False, schema: T.StructType | str | None = None,
             sampling_ratio: float | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    if value_tag:
        r = r.option("valueTag", value_tag)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", infer_leaf_types)
        if sampling_ratio:
            r = r.option("samplingRatio", sampling_ratio)
    return r.load(path)


def read_source(spark: SparkSession, file_spec: dict | FileSpec, path: str | list[str],
                schema: T.StructType | str | None = None, sampling_ratio: float | None = None,
                multi_line: bool = False) -> DataFrame:
    """Open a provider file as described by a mapping's ``file`` block."""
    spec = file_spec if isinstance(file_spec, FileSpec) else parse_file_spec(file_spec)
    if spec.format == "csv":
        return read_csv(spark, path, spec.header, spec.delimiter, schema, sampling_ratio)
    if spec.format == "json":
        return read_json(spark, path, multi_line, schema, sampling_ratio)
    return read_xml(spark, path, spec.row_tag, spec.value_tag, schema=schema, sampling_ratio=sampling_ratio)


#: Columns of ``read_records``: the text of a record that does not parse (else null), and the path of its file.
BROKEN = "__broken"
FILE = "__file"
#: Keeps a source without a single good record readable (Spark refuses to read the broken text alone).
_FILLER = "__none"


def record_schema(schema: T.StructType) -> T.StructType:
    """``schema`` with the column for broken records, without the one that inference adds."""
    fields = [f for f in schema.fields if f.name not in ("_corrupt_record", BROKEN)]
    return T.StructType((fields or [T.StructField(_FILLER, T.StringType())]) + [T.StructField(BROKEN, T.StringType())])


def read_records(spark: SparkSession, file_spec: dict | FileSpec, path: str | list[str],
                 schema: T.StructType | str | None = None, sampling_ratio: float | None = None,
                 multi_line: bool = False, stream: bool = False, **options) -> DataFrame:
    """``read_source`` with ``BROKEN`` and ``FILE``: broken JSON, a line with too many or too few fields, a value that
    does not fit a given schema, XML that does not close. Blank lines are no records.

    Read such a frame whole (stage it, or pass it through :func:`whole`): a pass that needs few columns parses only
    those, and would not see what is broken in the others.
    """
    spec = file_spec if isinstance(file_spec, FileSpec) else parse_file_spec(file_spec)
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if schema is None:
        schema = read_source(spark, spec, path, sampling_ratio=sampling_ratio, multi_line=multi_line).schema
    r = (spark.readStream if stream else spark.read).schema(record_schema(schema)).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, **options)
    if spec.format == "csv":
        r = r.format("csv").options(header=spec.header, sep=spec.delimiter)
    elif spec.format == "json":
        r = r.format("json").option("multiLine", multi_line)
    else:
        r = r.format("xml").option("rowTag", spec.row_tag)
        if spec.value_tag:
            r = r.option("valueTag", spec.value_tag)
    return r.load(path).withColumn(FILE, F.col("_metadata.file_path"))


def whole(records: DataFrame) -> DataFrame:
    """``records`` such that every pass over the text reads all its columns and so agrees on what is broken."""
    if any("variant" in f.dataType.simpleString() for f in records.schema.fields):
        return records  # parsed as a whole anyway
    all_ = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in records.schema.fields]
    return records.filter(F.xxhash64(*all_) >= F.lit(-(1 << 63)).cast("long"))


def split_broken(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that parsed, with ``FILE``; ``text, file`` of those that did not)."""
    good = records.filter(F.col(BROKEN).isNull()).drop(BROKEN, _FILLER)
    return good, records.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("text"), F.col(FILE).alias("file"))

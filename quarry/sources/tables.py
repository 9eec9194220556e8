"""Readers of the record model's tables, with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n.rstrip("!"), t, not n.endswith("!")) for n, t in fields])


SERVED = _schema(
    ("db_id!", L), ("id!", S), ("inquiry_number!", S), ("title!", S), ("url!", S), ("ip", S), ("inquiry_type", S),
    ("area_of_vehicle", S), ("vehicle_year", I), ("vehicle_make", S), ("vehicle_model", S), ("body", S), ("labor_type", S),
    ("issue_summary", S), ("suggested_action", S), ("resolution", S), ("status!", S), ("submitted_at!", TS),
    ("resolved_at", TS), ("last_updated!", TS), ("metadata!", S),
)
RAW = _schema(
    ("db_id!", L), ("database", S), ("inquiry_type", S), ("status", S), ("resolution_status", S), ("year", I), ("make", S),
    ("model", S), ("body", S), ("area_of_vehicle", S), ("oem_part_number", S), ("issue_summary", S), ("suggested_action", S),
    ("resolution", S), ("submission_date", S), ("resolution_date", S), ("submitted_datetime", S), ("source_url", S),
    ("body_fetched_at", S), ("last_seen_at", S), ("content_hash", S), ("delisted_at", S), ("dead_suspected_at", S), ("dead_at", S),
)
INDEX_ENTRY = _schema(
    ("db_id", S), ("post_id", S), ("database", S), ("InquiryType", S), ("VehicleData", S), ("status", S),
    ("SubmissionDate", S), ("ResolutionDate", S), ("ResolveTime", S), ("more", S),
)
PAIRS = _schema(("key", S), ("value", S))


class MissingTable(FileNotFoundError):
    """A table that was to be there is not."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def opened(spark: SparkSession, path: str, schema: T.StructType, create: bool = False) -> DataFrame:
    """A Parquet table; a missing one is refused, unless it may start empty.

    Columns that an older file lacks are null, so that schemas may grow.
    """
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    if create:
        return spark.createDataFrame([], schema)
    raise MissingTable(f"{path} is not there; pass create=True to begin a new table")


def corpus_file(spark: SparkSession, path: str) -> DataFrame:
    """A corpus as one JSON array; the first row that doesn't fit the schema fails the read."""
    fitted = T.StructType([T.StructField(f.name, f.dataType, True) for f in SERVED.fields])
    rows = spark.read.schema(fitted).option("multiLine", True).option("mode", "FAILFAST").json(path)
    for field in SERVED.fields:
        if not field.nullable:
            rows = rows.withColumn(field.name, F.when(F.col(field.name).isNull(), F.raise_error(F.lit(f"{field.name} is missing"))).otherwise(F.col(field.name)))
    return rows


def index_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a landed snapshot {count, data: [...]} with their arrival order."""
    envelope = T.StructType([T.StructField("count", L), T.StructField("data", T.ArrayType(INDEX_ENTRY))])
    return spark.read.schema(envelope).option("multiLine", True).json(path).select(F.posexplode("data").alias("pos", "e")).select("pos", "e.*")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """A key/value table; a missing one is empty, never an error."""
    return opened(spark, path, PAIRS, create=True)

"""Expressions and storage helpers that the operators share.

Tables have the columns of ``documents`` (doc_id, text, lang, source, n_chars) and may have
more; no helper looks at a column that it doesn't name. A null text counts as the empty text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without blanks."""
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. ASCII texts take the quick function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def rekeyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with its long keys as expressions of their own.

    A join beside an aggregate on the same keys takes the aggregate's partitions as they are, and
    then AQE may not split the other side's hot keys. New keys make the join shuffle both sides.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})


#: Bits of the filter of ``parted``: 4 MB, whatever the number of values.
FILTER_BITS, BUCKET_BITS = 1 << 25, 1 << 15


def parted(df: DataFrame, columns: list[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``columns`` may be a row of ``wanted``, all that are and few others, and the rows that surely are none.

    The hashes of the wanted rows set bits of a bitmap of a fixed size, whose parts are broadcast,
    so the second part needs no join. Beyond some ten millions of wanted rows most bits are
    set, and most rows are in the first part; the join that follows decides in any case.
    """

    def bit(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(FILTER_BITS))

    own = bit(wanted.columns)
    bits = wanted.select(F.floor(own / BUCKET_BITS).alias("__part"), (own % BUCKET_BITS).alias("__bit"))
    parts = bits.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    at = bit(columns)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at % BUCKET_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(parts), F.floor(at / BUCKET_BITS) == F.col("__part"), "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    return joined.filter(inside).select(*names), joined.filter(~inside).select(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. One of our own only in a local session that names none; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, in the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    The table stays until the application ends, or until it is ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    files, where = _at(spark, path)
    files.deleteOnExit(where.getParent())
    table = spark.read.schema(df.schema).parquet(path)
    table._quarry_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        files, where = _at(table.sparkSession, table._quarry_path)
        files.delete(where.getParent(), True)


#: Bytes of the batches that go to Python, where the session leaves Spark's default of 64 MB: a batch is held several times over on both sides.
BATCH_BYTES = "8m"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes. The bound is a session setting; one that the session has set stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) in (None, "67108864b", "64m", "64MB"):
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def mapped(docs: DataFrame, row: Callable[[pa.RecordBatch], list[pa.Array]], new: list[T.StructField]) -> DataFrame:
    """``docs`` with new columns from a function of a batch; a batch is cut by its bytes."""
    names = {f.name.lower() for f in new}
    stay = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in names]
    schema = T.StructType([*(docs.schema.fields[i] for i in stay), *new])
    labels = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(batch.num_rows, (8 << 20) * max(batch.num_rows, 1) // max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), *row(part)], labels)

    return in_arrow(docs, run, schema)

"""Incremental ingestion as a stream of landed snapshots: an extension over the batch operators.

Every micro-batch is one sync: plan against the table as it stands, refuse an implausible
snapshot, upsert, mark, and write the next version. Versions are directories that are never
rewritten, and the last one with Spark's success mark is the current one, so a lost driver or
executor leaves it whole, and a batch that is run again finds its version already there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import dml, sync
from quarry.sources import tables

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("db_id", "post_id", "database", "inquiry_type", "vehicle_data", "status", "submission_date", "resolution_date")] + [T.StructField("pos", T.LongType())])


class Store:
    """Versions of the crawl table under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending; a version is complete with its success mark."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], tables.RAW)
        return self.spark.read.schema(tables.RAW).parquet(f"{self.folder}/v{known[-1] if version is None else version}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


def apply_snapshot(held: DataFrame, entries: DataFrame, now: str, check: bool = True) -> DataFrame:
    """The table after one snapshot. The plan reads the table before the upsert, as it must."""
    live = sync.deduplicated(entries)
    if check:
        sync.require_sane(live, held)
    gone, back = sync.delisted_ids(live, held), sync.reappeared_ids(live, held)
    return dml.stamped_delisted(dml.upserted(held, dml.metadata_rows(live, now)), gone, back, now)


def handler(store: Store, now: Callable[[], str], check: bool = True) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: batch n writes version n + 1 once."""

    def run(batch: DataFrame, number: int) -> None:
        done = store.versions()
        if done and done[-1] >= number + 1:
            return
        store.write(apply_snapshot(store.read(), batch, now(), check and bool(done)), number + 1)

    return run


def start(spark: SparkSession, landing: str, store: Store, checkpoint: str, now: Callable[[], str], check: bool = True) -> StreamingQuery:
    """Takes every landed file once, one a batch, and stops when there is none left."""
    entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(landing)
    return entries.writeStream.foreachBatch(handler(store, now, check)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(items: DataFrame, size: int = 500) -> DataFrame:
    """The next items of a queue, new ones first, ids ascending."""
    return items.filter(F.col("state") == "queued").orderBy(*sync.queue_order()).limit(size)

"""Tables of one folder as numbered versions that are never rewritten.

A version is complete with Spark's success mark; readers take the last complete one, so a job
that dies leaves the tables as they were. ``keep`` versions stay, for readers still at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.sources import tables


class Store:
    def __init__(self, spark: SparkSession, folder: str, create: bool = False, keep: int = 3) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not create and not self.versions("raw"):
            raise tables.MissingTable(f"{folder} holds no corpus; pass create=True to begin one")

    def versions(self, name: str) -> list[int]:
        """Numbers of the complete versions of a table, ascending."""
        at = f"{self.folder}/{name}"
        if not self._fs.exists(self._path(at)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(f"{at}/{n}/_SUCCESS")))

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        known = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{known[-1]}") if known else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes the next version and returns it as it was written."""
        known = self.versions(name)
        path = f"{self.folder}/{name}/v{known[-1] + 1 if known else 1}"
        rows.write.mode("overwrite").parquet(path)
        for old in known[: max(0, len(known) + 1 - self.keep)]:
            self._fs.delete(self._path(f"{self.folder}/{name}/v{old}"), True)
        return self.spark.read.schema(rows.schema).parquet(path)

"""Where results go: the served corpus, its currency, the index, and load statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import freshness
from quarry.operators import index, serve


def write_corpus(corpus: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """The corpus as Parquet, sorted by effective date within files so that recent windows prune; a dry run writes nothing."""
    if not dry_run:
        corpus.withColumn("effective_at", F.coalesce("resolved_at", "submitted_at")).sortWithinPartitions("effective_at").write.mode("overwrite").parquet(path)
    return corpus


def write_json(corpus: DataFrame, path: str, dry_run: bool = False) -> None:
    """The corpus as JSON lines, one record each, dates as ISO text, absent fields left out."""
    if not dry_run:
        serve.to_rows(corpus).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_json_array(corpus: DataFrame, path: str, dry_run: bool = False) -> None:
    """The corpus as one file with one indented JSON array, by id. One file is one task's output: the records stream through it."""
    if dry_run:
        return
    rows = serve.to_rows(corpus)
    last = F.broadcast(rows.agg(F.max("db_id").alias("__last")))
    lines = F.concat(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "true"}), F.when(F.col("db_id") < F.col("__last"), ",").otherwise(""))
    ends = rows.sparkSession.createDataFrame([(0, None, "["), (2, None, "]")], "part int, db_id long, value string")
    ends.unionByName(rows.join(last).select(F.lit(1).alias("part"), "db_id", lines.alias("value"))).coalesce(1).sortWithinPartitions("part", "db_id").select("value").write.mode("overwrite").text(path)


def write_freshness(corpus: DataFrame, path: str) -> None:
    """The corpus's currency as key/value rows; all rows are replaced."""
    freshness.as_pairs(freshness.summary(corpus)).coalesce(1).write.mode("overwrite").parquet(path)


def write_index(found: index.Index, path: str) -> None:
    """The index's tables; postings range-partitioned and sorted by term, so that a term or prefix reads few row groups."""
    found.postings.repartitionByRange("term").sortWithinPartitions("term", "db_id").write.mode("overwrite").parquet(f"{path}/postings")
    found.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark, path: str) -> index.Index:
    return index.Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def write_phrases(found: index.PhraseIndex, path: str) -> None:
    """The phrase index's tables, sorted by the word that queries look for: pairs by the second, which is matched by its beginning."""
    found.words.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/words")
    found.pairs.repartitionByRange("second").sortWithinPartitions("second", "first").write.mode("overwrite").parquet(f"{path}/pairs")


def read_phrases(spark, path: str) -> index.PhraseIndex:
    return index.PhraseIndex(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/pairs"))


def write_statements(corpus: DataFrame, table: str, path: str, lanes: int = 1) -> None:
    """The corpus as packed INSERT statements, one statement a row of text."""
    serve.insert_statements(serve.to_rows(corpus), table, lanes).select("statement").write.mode("overwrite").text(path)

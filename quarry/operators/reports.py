"""Counts and summaries over the corpus, the crawl table and the queue."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import sync


def frequency(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """(value, n) of a column, most frequent first, names among equals."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def status_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(F.col("resolution_status") == "resolved").alias("resolved"), F.count_if(F.col("resolution_status") == "pending").alias("pending"), F.count("*").alias("total"))


def high_water(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(high_water, provenance): the stored mark, else the greatest id, 0 of an empty table."""
    most = raw.agg(F.coalesce(F.max("db_id"), F.lit(0)).alias("most"))
    if stored is None:
        return most.select(F.col("most").alias("high_water"), F.lit("derived").alias("provenance"))
    mark = stored.agg(F.max(F.when(F.col("key") == "last_id", F.col("value"))).try_cast("bigint").alias("mark"))
    return most.join(F.broadcast(mark)).select(F.coalesce("mark", "most").alias("high_water"), F.when(F.col("mark").isNull(), "derived").otherwise("stored").alias("provenance"))


def run_summary(items: DataFrame) -> DataFrame:
    """Items of each run by state."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("written", "unchanged", "skipped", "queued")]
    return items.groupBy("run_id").agg(*states, F.count("*").alias("total"))


def queued(items: DataFrame) -> DataFrame:
    """Items still queued, by run and pass."""
    return items.filter("state = 'queued'").groupBy("run_id", "pass").agg(F.count("*").alias("n"))


def change_histogram(items: DataFrame) -> DataFrame:
    """How often each field changed in refresh passes."""
    changed = items.filter("pass = 'refresh' and changed = 1").select(F.explode(F.split("changed_fields", ",")).alias("field")).filter("field != ''")
    return changed.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def pending_ids(raw: DataFrame) -> DataFrame:
    return raw.filter("body_fetched_at is null").select("db_id")


def non_delisted(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if(F.col("delisted_at").isNull()).alias("n"))


def span(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n"), F.min("submitted_at").alias("first_at"), F.max("submitted_at").alias("last_at"))


def load_sizes(values: DataFrame) -> DataFrame:
    """Rows, characters and the longest row of what is to be loaded."""
    return values.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("characters"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("longest"))


def estimate(queue: DataFrame, batch: int = 500, seconds: int = 2) -> DataFrame:
    """Items by pass with the minutes and batches that they take at a polite pace."""
    return queue.groupBy("pass").agg(F.count("*").alias("n")).select("pass", "n", F.round(F.col("n") * seconds / 60).cast("long").alias("minutes"), F.ceil(F.col("n") / batch).alias("batches"))


#: Leading characters of an id by which records are dealt out to be ranked.
HEAD = 4
#: What a report lists in full: skipped items, errors, ids of a cohort.
SKIPPED_SHOWN, ERRORS_SHOWN, IDS_SHOWN = 25, 20, 20


def positions(corpus: DataFrame) -> DataFrame:
    """The first, middle and last record by id as text.

    Ids are counted by their heads; the heads' running counts, a row each, say in which heads the
    wanted places lie, and only the ids there are ranked.
    """
    ids = corpus.select("id", F.substring("id", 1, HEAD).alias("head"))
    heads = ids.groupBy("head").agg(F.count("*").alias("size")).withColumn("upto", F.sum("size").over(Window.orderBy("head")))
    n = F.col("n")
    heads = heads.withColumn("n", F.max("upto").over(Window.partitionBy()))
    wanted = heads.withColumn("place", F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.floor(n / 2) + 1, n)))).withColumn("before", F.col("upto") - F.col("size"))
    wanted = wanted.filter((F.col("before") < F.col("place")) & (F.col("place") <= F.col("upto"))).select("head", "before", "place")
    ranked = ids.join(F.broadcast(wanted.select("head").distinct()), "head").withColumn("in_head", F.row_number().over(Window.partitionBy("head").orderBy("id")))
    return ranked.join(F.broadcast(wanted), "head").filter(F.col("before") + F.col("in_head") == F.col("place")).select("place", "id")


def first_ids(corpus: DataFrame, most: int = 5) -> DataFrame:
    """The first ids of a corpus, as a report shows them: a top-k."""
    return corpus.select("db_id").orderBy("db_id").limit(most)


def skipped(items: DataFrame, run_id: int, most: int = SKIPPED_SHOWN) -> DataFrame:
    """The first skipped items of a run with status and reason: a top-k."""
    return items.filter((F.col("run_id") == run_id) & (F.col("state") == "skipped")).select("db_id", "http_status", "reason").orderBy("db_id").limit(most)


def cohorts(live: DataFrame, held: DataFrame, today: str, window: int, index_only: bool = False) -> DataFrame:
    """(cohort, n, first_id, last_id) of a sync plan, a row for every cohort, the queue included."""
    none = held.select("db_id").limit(0)
    parts = {
        "new": sync.new_ids(live, held),
        "gaps": sync.gap_ids(live, held, high_water(held)),
        "changed": sync.changed_ids(live, held),
        "unresolved": none if index_only else sync.unresolved_ids(held),
        "suspected": sync.suspected_ids(held),
        "blank": none if index_only else sync.blank_resolved_ids(held, today),
        "trailing": none if index_only else sync.trailing_ids(held, window),
        "delisted": sync.delisted_ids(live, held),
        "reappeared": sync.reappeared_ids(live, held),
        "queue": sync.queue(live, held, today, window, index_only).select("db_id"),
    }
    found = functools.reduce(DataFrame.unionByName, [ids.agg(F.count("*").alias("n"), F.min("db_id").alias("first_id"), F.max("db_id").alias("last_id")).withColumn("cohort", F.lit(name)) for name, ids in parts.items()])
    return found.select("cohort", "n", "first_id", "last_id")


def first_rows(rows: DataFrame, column: str = "db_id", most: int = IDS_SHOWN) -> list:
    """A list of ids as a report shows it, no longer than ``most``."""
    return [r[0] for r in rows.select(column).orderBy(column).limit(most).collect()]

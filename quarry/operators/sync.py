"""Planning a sync: an upstream snapshot against what is held.

All steps read the tables as they stood before anything is written; frames are immutable, so
the order of planning before writing holds by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import record

#: Fixed limits: the least share of held rows that a snapshot must cover, the most that one run may delist.
LEAST_SHARE, MOST_DELISTED = 0.9, 50
BLANK_DAYS = 365
#: Sequence numbers of a run that one task counts.
BLOCK = 100_000


def deduplicated(entries: DataFrame) -> DataFrame:
    """The last entry in arrival order for each numeric id; rows whose id has no number go.

    One struct maximum per id, summed on the map side: a hot id costs one row per partition.
    """
    numbered = entries.withColumn("id", record.lenient_int(F.col("db_id"))).filter("id is not null")
    rest = [c for c in entries.columns if c != "db_id"]
    return numbered.groupBy("id").agg(F.max(F.struct("pos", *[c for c in rest if c != "pos"])).alias("e")).select(F.col("id").alias("db_id"), "e.*")


def _bare(column: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def new_ids(live: DataFrame, held: DataFrame) -> DataFrame:
    return live.select("db_id").join(held.select("db_id"), "db_id", "left_anti")


def changed_ids(live: DataFrame, held: DataFrame) -> DataFrame:
    """Held ids whose status or resolution date reads otherwise in the snapshot."""
    before = held.select("db_id", _bare("status").alias("s0"), _bare("resolution_date").alias("d0"))
    after = live.select("db_id", _bare("status").alias("s1"), _bare("resolution_date").alias("d1"))
    return after.join(before, "db_id").filter("s0 != s1 or d0 != d1").select("db_id")


def delisted_ids(live: DataFrame, held: DataFrame) -> DataFrame:
    """Held ids that the snapshot no longer has and that aren't marked so yet."""
    return held.filter("delisted_at is null").select("db_id").join(live.select("db_id"), "db_id", "left_anti")


def reappeared_ids(live: DataFrame, held: DataFrame) -> DataFrame:
    return held.filter("delisted_at is not null").select("db_id").join(live.select("db_id"), "db_id", "left_semi")


def unresolved_ids(held: DataFrame) -> DataFrame:
    return held.filter("delisted_at is null and dead_at is null and (resolution_status = 'pending' or status = 'Submitted to IP')").select("db_id")


def blank_resolved_ids(held: DataFrame, today: str) -> DataFrame:
    """Resolved within a year, or at an unknown date, and still without a resolution's text."""
    cutoff = F.date_sub(F.lit(today).cast("date"), BLANK_DAYS).cast("string")
    blank = F.col("resolution").isNull() | F.col("resolution").isin("", record.PLACEHOLDER)
    recent = F.col("resolution_date").isNull() | (F.col("resolution_date") == "") | (F.col("resolution_date") >= cutoff)
    listed = F.col("delisted_at").isNull() & F.col("dead_at").isNull()
    return held.filter(listed & F.startswith(F.lower("status"), F.lit("resolved")) & blank & recent).select("db_id")


def trailing_ids(held: DataFrame, most: int) -> DataFrame:
    """The newest ids that are neither delisted nor dead, ascending: a top-k."""
    return held.filter("delisted_at is null and dead_at is null").select("db_id").orderBy(F.desc("db_id")).limit(most).orderBy("db_id")


def suspected_ids(held: DataFrame) -> DataFrame:
    """Suspected dead and not confirmed, whether delisted or not."""
    return held.filter("dead_suspected_at is not null and dead_at is null").select("db_id")


def dead_ids(held: DataFrame) -> DataFrame:
    return held.filter("dead_at is not null").select("db_id")


def gap_ids(live: DataFrame, held: DataFrame, high_water: DataFrame) -> DataFrame:
    """New ids at or below the high-water mark (one row): gaps, not growth."""
    return new_ids(live, held).join(F.broadcast(high_water.select("high_water"))).filter("db_id <= high_water").select("db_id")


def queue(live: DataFrame, held: DataFrame, today: str, window: int, index_only: bool = False) -> DataFrame:
    """(pass, db_id): new ids, and the union of the cohorts to refresh without what was just delisted, is dead or is new."""
    fresh = new_ids(live, held)
    cohorts = changed_ids(live, held).unionByName(suspected_ids(held))
    if not index_only:
        cohorts = cohorts.unionByName(unresolved_ids(held)).unionByName(blank_resolved_ids(held, today)).unionByName(trailing_ids(held, window))
    skip = delisted_ids(live, held).unionByName(dead_ids(held)).unionByName(fresh)
    refresh = cohorts.distinct().join(skip, "db_id", "left_anti")
    return fresh.select(F.lit("new").alias("pass"), "db_id").unionByName(refresh.select(F.lit("refresh").alias("pass"), "db_id"))


def queue_order() -> list[Column]:
    return [F.when(F.col("pass") == "new", 0).otherwise(1).asc(), F.col("db_id").asc()]


def plan_sanity(live: DataFrame, held: DataFrame) -> DataFrame:
    """One row: what the snapshot covers, what it would delist, and whether to act on it at all."""
    counts = held.agg(F.count_if(F.col("delisted_at").isNull()).alias("held")).join(F.broadcast(live.agg(F.count("*").alias("live"), F.coalesce(F.max("db_id"), F.lit(0)).alias("max_id"))))
    counts = counts.join(F.broadcast(delisted_ids(live, held).agg(F.count("*").alias("delisted"))))
    share = F.when(F.col("held") > 0, F.col("live") / F.col("held"))
    covered = F.coalesce(share >= LEAST_SHARE, F.lit(True))
    bounded = F.col("delisted") <= MOST_DELISTED
    return counts.select("held", "live", "max_id", "delisted", share.alias("share"), covered.alias("covered"), bounded.alias("bounded"), (covered & bounded).alias("ok"))


class ImplausibleSnapshot(RuntimeError):
    """A snapshot that the plan refuses to act on."""


def require_sane(live: DataFrame, held: DataFrame) -> None:
    row = plan_sanity(live, held).first()
    if not row["ok"]:
        raise ImplausibleSnapshot(f"the snapshot covers {row['live']} of {row['held']} held rows and would delist {row['delisted']}")


def transient(status: Column) -> Column:
    return (status == 0) | (status == 429) | (status >= 500)


def page_gone(status: Column, reason: Column) -> Column:
    return (status == 404) | F.coalesce(F.startswith(reason, F.lit("soft-404")), F.lit(False))


def breaker(outcomes: DataFrame, threshold: int = 10) -> DataFrame:
    """Per run, where its fetching stops: the first outcome that ends ``threshold`` transient ones in a row.

    How many an outcome ends is its place less the place of the last non-transient one. Both
    are counted within blocks of a run, and the blocks' counts carried over one row a block, so a
    long run is dealt over many tasks.
    """
    block = F.floor(F.col("seq") / BLOCK)
    within = Window.partitionBy("run_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = outcomes.withColumns({"block": block, "bad": F.coalesce(transient(F.col("http_status")), F.lit(False))}).withColumn("place", F.count("*").over(within))
    rows = rows.withColumn("good", F.max(F.when(~F.col("bad"), F.col("place"))).over(within))
    before = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("run_id", "block").agg(F.count("*").alias("n"), F.max("good").alias("last"))
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumn("carried", F.coalesce(F.max(F.col("offset") + F.col("last")).over(before), F.lit(0))).select("run_id", "block", "offset", "carried")
    in_row = F.col("offset") + F.col("place") - F.coalesce(F.col("offset") + F.col("good"), F.col("carried"))
    rows = rows.join(blocks, ["run_id", "block"]).withColumn("in_row", in_row)
    return rows.groupBy("run_id").agg(F.min(F.when(F.col("in_row") >= threshold, F.col("seq"))).alias("stopped_at"), F.max("in_row").cast("long").alias("longest"))


def two_strikes(outcomes: DataFrame) -> DataFrame:
    """Per id after its outcomes in order: alive, suspected after one gone page, dead after two; success clears both.

    What counts is the number of gone pages after the last success; other failures change nothing.
    """
    order = Window.partitionBy("db_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    gone = page_gone(F.col("http_status"), F.col("reason"))
    cleared = F.max((F.col("http_status") == 200).cast("int")).over(order)
    strikes = outcomes.withColumn("cleared", cleared).withColumn("gone", gone)
    after = F.sum((F.col("gone") & (F.col("cleared") == 0)).cast("int"))
    rows = strikes.groupBy("db_id").agg(F.coalesce(after, F.lit(0)).alias("strikes"), F.max("cleared").alias("c"))
    state = F.when(F.col("strikes") == 0, "alive").when(F.col("strikes") == 1, "suspected").otherwise("dead")
    return rows.select("db_id", state.alias("state"), "strikes", (F.col("c") == 1).alias("cleared"))

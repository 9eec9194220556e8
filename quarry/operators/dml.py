"""Writes as new versions of immutable tables: upserts, merges, marks and queue outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import record
from quarry.sources import tables

C = F.col
RAW = [f.name for f in tables.RAW.fields]
PAGE_FIELDS = ("inquiry_type", "area_of_vehicle", "oem_part_number", "issue_summary", "suggested_action", "resolution", "resolution_status", "year", "make", "model", "body", "submitted_datetime")


def metadata_rows(entries: DataFrame, now: str, site: str = "https://inquiries.example") -> DataFrame:
    """Deduplicated index entries as the rows that an upsert takes."""
    v = record.vehicle(F.coalesce("vehicle_data", F.lit("")))
    return entries.withColumn("v", v).select(
        "db_id", "database", "inquiry_type", "status", record.index_status(C("status")).alias("resolution_status"), "v.year", "v.make", "v.model",
        "submission_date", "resolution_date", F.concat(F.lit(f"{site}/"), C("db_id").cast("string"), F.lit("/")).alias("source_url"), F.lit(now).alias("last_seen_at"),
    )


def upserted(held: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after an upsert: index fields are overwritten, a held vehicle stays, and a moved status or date forgets the fetched page.

    A comparison with null is not a move.
    """
    new = rows.select(*[C(c).alias(f"n_{c}") for c in rows.columns])
    both = held.join(new, C("db_id") == C("n_db_id"), "full_outer")
    there = C("n_db_id").isNotNull()
    moved = there & F.coalesce(C("n_status") != C("status"), F.lit(False)) | there & F.coalesce(C("n_resolution_date") != C("resolution_date"), F.lit(False))
    values: dict[str, Column] = {"db_id": F.coalesce("db_id", "n_db_id"), "body_fetched_at": F.when(moved, F.lit(None).cast("string")).otherwise(C("body_fetched_at"))}
    for c in rows.columns[1:]:
        values[c] = F.coalesce(c, f"n_{c}") if c in ("year", "make", "model") else F.when(there, C(f"n_{c}")).otherwise(C(c))
    return both.select(*[values.get(c, C(c)).alias(c) for c in RAW])


def _with_pages(held: DataFrame, pages: DataFrame) -> tuple[DataFrame, Column]:
    new = pages.select("db_id", *[C(c).alias(f"p_{c}") for c in PAGE_FIELDS], F.lit(True).alias("p_there"))
    return held.join(new, "db_id", "left"), F.coalesce(C("p_there"), F.lit(False))


def backfilled(held: DataFrame, pages: DataFrame, now: str) -> DataFrame:
    """Pages fetched for the first time: held type and vehicle stay, all else is the page's."""
    both, there = _with_pages(held, pages)
    values = {"body_fetched_at": F.when(there, F.lit(now)).otherwise(C("body_fetched_at"))}
    for c in PAGE_FIELDS:
        values[c] = F.coalesce(c, f"p_{c}") if c in ("inquiry_type", "year", "make", "model", "body") else F.when(there, C(f"p_{c}")).otherwise(C(c))
    return both.select(*[values.get(c, C(c)).alias(c) for c in RAW])


def suspect(field=F.col) -> Column:
    """A page without content against a row that had some. An empty type hides a summary that is there."""
    empty = (F.coalesce(field("p_resolution"), F.lit("")).isin("", record.PLACEHOLDER)) & (F.concat_ws("", *[field(f"p_{c}") for c in ("inquiry_type", "area_of_vehicle", "issue_summary", "suggested_action")]) == "")
    return empty & (F.coalesce(F.coalesce(field("inquiry_type"), field("issue_summary"), field("suggested_action")), F.lit("")) != "")


def merged(c: str) -> Column:
    """A field after merging: the page's value unless null; a make only if it is plausible; the resolution always the page's."""
    held = F.nullif(C(c), F.lit("")) if c != "year" else C(c)
    if c in ("resolution", "resolution_status"):
        return C(f"p_{c}")
    if c == "make":
        return F.when(record.implausible_make(C("p_make")), held).otherwise(C("p_make"))
    return F.coalesce(C(f"p_{c}"), held)


def refreshed(held: DataFrame, pages: DataFrame, now: str) -> DataFrame:
    """Rows that have a page, classified and merged: the table's columns, plus outcome and changed_fields.

    skipped: the page is suspect. unchanged: the hash agrees, or no field differs (the hash is
    then set). written: all content is overwritten; resolution_status is the index's and stays.
    """
    both, there = _with_pages(held, pages)
    rows = both.filter(there).withColumns({f"m_{c}": merged(c) for c in PAGE_FIELDS})

    def after(name: str) -> Column:
        return C(f"m_{name}") if name in PAGE_FIELDS else C(name)

    rows = rows.withColumns({"hash": record.content_hash(after), "diff": record.changed_fields(F.col, after)})
    same = F.coalesce(C("content_hash") == C("hash"), F.lit(False))
    rows = rows.withColumn("outcome", F.when(suspect(), "skipped").when(same | (F.size("diff") == 0), "unchanged").otherwise("written"))
    write = C("outcome") == "written"
    values = {c: F.when(write, C(f"m_{c}")).otherwise(C(c)) for c in PAGE_FIELDS if c != "resolution_status"}
    values["content_hash"] = F.when(C("outcome") == "skipped", C("content_hash")).otherwise(C("hash"))
    values["body_fetched_at"] = F.when(write, F.lit(now)).otherwise(C("body_fetched_at"))
    return rows.select(*[values.get(c, C(c)).alias(c) for c in RAW], "outcome", F.when(write, F.array_join("diff", ",")).alias("changed_fields"))


def stamped_delisted(held: DataFrame, gone: DataFrame, back: DataFrame, now: str) -> DataFrame:
    """Marks the delisted, keeping an earlier mark, and clears the reappeared."""
    marks = gone.select("db_id", F.lit(True).alias("gone")).unionByName(back.select("db_id", F.lit(False).alias("gone"))).groupBy("db_id").agg(F.max("gone").alias("gone"))
    value = F.when(C("gone"), F.coalesce("delisted_at", F.lit(now))).when(~C("gone"), F.lit(None)).otherwise(C("delisted_at"))
    return held.join(marks, "db_id", "left").withColumn("delisted_at", value).select(*RAW)


def marked_dead(held: DataFrame, strikes: DataFrame, now: str) -> DataFrame:
    """Applies what two_strikes found: success clears both marks, a gone page suspects, the next one confirms; earlier marks count."""
    both = held.join(strikes.select("db_id", "strikes", "cleared"), "db_id", "left")
    seen, k = C("strikes").isNotNull(), C("strikes")
    before = C("dead_suspected_at").isNotNull()
    total = k + F.when(before, 1).otherwise(0)
    suspected = F.when(~seen, C("dead_suspected_at")).when(C("cleared"), F.when(k > 0, F.lit(now))).otherwise(F.when(total > 0, F.coalesce("dead_suspected_at", F.lit(now))))
    dead = F.when(~seen, C("dead_at")).when(C("cleared"), F.when(k > 1, F.lit(now))).otherwise(F.when((k > 0) & (total > 1), F.coalesce("dead_at", F.lit(now))).otherwise(C("dead_at")))
    return both.withColumns({"dead_suspected_at": suspected, "dead_at": dead}).select(*RAW)


def repaired_makes(rows: DataFrame) -> DataFrame:
    """Two-word makes whose second word slipped into the model, put together again; ``repaired`` names the make."""
    make, model, repaired = C("make"), C("model"), F.lit(None).cast("string")
    for full in record.TWO_WORD_MAKES:
        first, rest = full.lower().split(" ")
        hit = (F.lower("make") == first) & ((F.lower("model") == rest) | F.startswith(F.lower("model"), F.lit(f"{rest} ")))
        make = F.when(hit, F.concat(C("make"), F.lit(" "), F.substring("model", 1, len(rest)))).otherwise(make)
        model = F.when(hit, F.nullif(F.trim(F.substring("model", len(rest) + 1, 1 << 30)), F.lit(""))).otherwise(model)
        repaired = F.when(hit, full).otherwise(repaired)
    return rows.withColumns({"make": make, "model": model, "repaired": repaired})


def enqueued(items: DataFrame, run_id: int, queue: DataFrame, now: str) -> DataFrame:
    """The queue with a run's items; those already there are left as they are."""
    new = queue.join(items.filter(C("run_id") == run_id).select("db_id"), "db_id", "left_anti")
    rows = new.select(F.lit(run_id).cast("long").alias("run_id"), "db_id", "pass", F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("changed"), F.lit(None).cast("string").alias("changed_fields"), F.lit(now).alias("updated_at"))
    return items.unionByName(rows, allowMissingColumns=True)


def recorded(items: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """The queue after outcomes (run_id, db_id, state, http_status, reason, changed, changed_fields): one attempt more; a transient one stays queued."""
    new = outcomes.select("run_id", "db_id", *[C(c).alias(f"o_{c}") for c in ("state", "http_status", "reason", "changed", "changed_fields")], F.lit(True).alias("o_there"))
    both = items.join(new, ["run_id", "db_id"], "left")
    there = F.coalesce("o_there", F.lit(False))
    state = F.when(there & (C("o_state") != "transient"), C("o_state")).otherwise(C("state"))
    values = {c: F.when(there, C(f"o_{c}")).otherwise(C(c)) for c in ("http_status", "reason", "changed", "changed_fields")}
    return both.withColumns({"state": state, "attempts": C("attempts") + there.cast("int"), "updated_at": F.when(there, F.lit(now)).otherwise(C("updated_at")), **values}).select(*items.columns)


def pairs_upserted(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """A key/value table with the new values."""
    return pairs.join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


RUNS = "run_id long, started_at string, finished_at string, mode string, refresh_window int, index_max_db_id long, index_count long, status string"


def run_started(runs: DataFrame, mode: str, window: int, index_max: int | None, index_count: int | None, now: str) -> DataFrame:
    """The runs with a new one, numbered after the last."""
    number = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).cast("long").alias("run_id"))
    new = number.select("run_id", F.lit(now).alias("started_at"), F.lit(None).cast("string").alias("finished_at"), F.lit(mode).alias("mode"), F.lit(window).alias("refresh_window"), F.lit(index_max).cast("long").alias("index_max_db_id"), F.lit(index_count).cast("long").alias("index_count"), F.lit("running").alias("status"))
    return runs.unionByName(new)


def run_finished(runs: DataFrame, run_id: int, status: str, now: str) -> DataFrame:
    mine = C("run_id") == run_id
    return runs.withColumns({"status": F.when(mine, status).otherwise(C("status")), "finished_at": F.when(mine, now).otherwise(C("finished_at"))})


def resumable(runs: DataFrame) -> DataFrame:
    """The newest run that still has work: one row or none."""
    return runs.filter(C("status").isin("running", "interrupted")).orderBy(F.desc("run_id")).limit(1)


def advanced(pairs: DataFrame, items: DataFrame, runs: DataFrame, run_id: int) -> DataFrame:
    """The key/value table after a run: the high-water mark moves to the index's greatest id only if no new item is left in the queue."""
    mine = C("run_id") == run_id
    left = items.filter(mine & (C("pass") == "new")).agg(F.count_if(C("state") == "queued").alias("left"))
    top = runs.filter(mine & C("index_max_db_id").isNotNull()).select(C("index_max_db_id").cast("string").alias("value"))
    return pairs_upserted(pairs, top.join(F.broadcast(left)).filter(C("left") == 0).select(F.lit("last_id").alias("key"), "value"))

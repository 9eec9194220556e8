"""The record model laid over the synthetic tables, for tests, queries and benchmarks.

A document becomes an inquiry: its first line is the issue, its second the suggested action, the
rest the resolution; other fields follow from its source, language and size. Events become the
entries of an upstream index: every event reports the status of one document, in order.
Nothing is left out: whole tables, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import record

#: "Now" of all registered queries: 2026-05-07 12:00 UTC.
NOW = "2026-05-07T12:00:00Z"
TODAY = "2026-05-07"
TYPES = ("Refinish Operations", "Body Operations", "Paint Operations", "Frame", "Mechanical")
MAKES = ("Ford", "Land Rover", "toyota", "Mercedes Benz", "HONDA", "Alfa Romeo", "Great Wall")
MODELS = ("F150", "Range Sport", "Corolla", "C 300", "Civic", "Giulia", "H6")
BODIES = ("Sedan", "Pickup", "SUV")
AREAS = {"en": "Front Bumper", "de": "Rear Door", "fr": "Roof", "es": "Quarter Panel"}
#: Sources whose documents the upstream has retired, had retired before, or answers no more.
RETIRED, RETIRED_BEFORE, SUSPECTED, DEAD = "src7", "src5", "src4", "src3"
#: Language of the documents that have not been crawled yet.
UNSEEN = "es"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("db_id"),
        "source",
        "lang",
        "n_chars",
        F.substring("source", 4, 10).try_cast("int").alias("number"),
        F.get(lines, F.lit(0)).alias("first"),
        F.get(lines, F.lit(1)).alias("second"),
        F.when(F.size(lines) > 2, F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).alias("rest"),
    )


def _area() -> Column:
    return F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])[F.col("lang")]


def _submitted() -> Column:
    days = F.pmod(F.col("db_id"), F.lit(4000)).cast("int")
    return F.timestamp_millis(F.lit(1420070400000) + days.cast("long") * 86400000 + F.pmod(F.col("db_id"), F.lit(86400)) * 1000)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served corpus: the 21 columns of the served table."""
    d = _documents(spark, sf_dir).withColumn("submitted_at", _submitted())
    kind = pick(TYPES, F.col("number"))
    resolved = F.when(F.col("rest").isNotNull(), F.timestamp_millis(F.unix_millis("submitted_at") + (1 + F.pmod("n_chars", F.lit(60))) * 86400000))
    seen = F.concat(F.lit('{"lastSeenAt":"2026-05-0'), (1 + F.pmod(F.col("number"), F.lit(6))).cast("string"), F.lit('T08:00:00.000Z"}'))
    return (
        d.withColumns({"inquiry_type": kind, "resolved_at": resolved, "area_of_vehicle": _area()})
        .select(
            "db_id",
            F.col("db_id").cast("string").alias("id"),
            F.col("db_id").cast("string").alias("inquiry_number"),
            F.concat_ws(": ", "inquiry_type", "area_of_vehicle").alias("title"),
            F.concat(F.lit("https://inquiries.example/"), F.col("db_id").cast("string"), F.lit("/")).alias("url"),
            F.get(F.array(F.lit("CCC"), F.lit("Mitchell"), F.lit("Audatex")), F.pmod(F.col("number"), F.lit(4)).cast("int")).alias("ip"),
            "inquiry_type",
            "area_of_vehicle",
            (2005 + F.pmod("n_chars", F.lit(20))).cast("int").alias("vehicle_year"),
            pick(MAKES, F.col("n_chars")).alias("vehicle_make"),
            pick(MODELS, F.col("n_chars")).alias("vehicle_model"),
            pick(BODIES, F.col("n_chars")).alias("body"),
            record.labour_type(F.col("inquiry_type")).alias("labor_type"),
            F.col("first").alias("issue_summary"),
            F.col("second").alias("suggested_action"),
            F.col("rest").alias("resolution"),
            F.when(F.col("resolved_at").isNull(), "pending").otherwise("resolved").alias("status"),
            "submitted_at",
            "resolved_at",
            F.coalesce("resolved_at", "submitted_at").alias("last_updated"),
            seen.alias("metadata"),
        )
    )


def _date(ts: Column) -> Column:
    return record.day(ts)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl table as held before a sync: the 24 columns, without the documents not yet seen."""
    d = _documents(spark, sf_dir).filter(F.col("lang").isNull() | (F.col("lang") != UNSEEN)).withColumn("at", _submitted())
    stamp = F.lit("2026-04-01T00:00:00.000Z")
    answered = F.col("rest").isNotNull()
    return d.select(
        "db_id",
        pick(("CCC", "Mitchell", "Audatex", "Other"), F.col("number")).alias("database"),
        pick(TYPES, F.col("number")).alias("inquiry_type"),
        F.when(answered, "Resolved (Final Response)").otherwise("Submitted to IP").alias("status"),
        F.when(answered, "resolved").otherwise("pending").alias("resolution_status"),
        (2005 + F.pmod("n_chars", F.lit(20))).cast("int").alias("year"),
        F.element_at(F.split(pick(MAKES, F.col("n_chars")), " "), 1).alias("make"),
        F.concat_ws(" ", F.get(F.split(pick(MAKES, F.col("n_chars")), " "), F.lit(1)), pick(MODELS, F.col("n_chars"))).alias("model"),
        pick(BODIES, F.col("n_chars")).alias("body"),
        _area().alias("area_of_vehicle"),
        F.lit(None).cast("string").alias("oem_part_number"),
        F.nullif(F.col("first"), F.lit("")).alias("issue_summary"),
        F.col("second").alias("suggested_action"),
        F.when(answered & (F.length("rest") < 40), record.PLACEHOLDER).otherwise(F.coalesce("rest", F.lit(record.PLACEHOLDER))).alias("resolution"),
        _date(F.col("at")).alias("submission_date"),
        F.when(answered, _date(F.timestamp_millis(F.unix_millis("at") + 30 * 86400000))).alias("resolution_date"),
        F.concat(_date(F.col("at")), F.lit(" 09:30:00")).alias("submitted_datetime"),
        F.concat(F.lit("https://inquiries.example/"), F.col("db_id").cast("string"), F.lit("/")).alias("source_url"),
        F.when(F.col("number") != 2, stamp).alias("body_fetched_at"),
        stamp.alias("last_seen_at"),
        F.lit(None).cast("string").alias("content_hash"),
        F.when(F.col("source") == RETIRED_BEFORE, stamp).alias("delisted_at"),
        F.when(F.col("source").isin(SUSPECTED, DEAD), stamp).alias("dead_suspected_at"),
        F.when(F.col("source") == DEAD, stamp).alias("dead_at"),
    )


STATUS_OF_EVENT = ("Submitted to IP", "Resolved (IP Change)", "Resolved (No IP Change)", "Resolved (Final Response)", " resolved (late) ")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of an upstream index in arrival order (pos), several for most ids; all fields are text."""
    events = table(spark, sf_dir, "events")
    documents = _documents(spark, sf_dir).withColumn("at", _submitted())
    size = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    entry = events.select(F.col("event_id").alias("pos"), F.pmod(F.col("event_id"), size).alias("db_id"), F.pmod(F.length("event_type") + F.col("user_id"), F.lit(5)).cast("int").alias("k"))
    listed = documents.filter(F.col("source").isNull() | (F.col("source") != RETIRED))
    status = F.get(F.array(*[F.lit(s) for s in STATUS_OF_EVENT]), F.col("k"))
    return entry.join(listed, "db_id").select(
        "pos",
        F.col("db_id").cast("string").alias("db_id"),
        F.col("pos").cast("string").alias("post_id"),
        pick(("CCC", "Mitchell", "Audatex", "Other"), F.col("number")).alias("database"),
        pick(TYPES, F.col("number")).alias("inquiry_type"),
        F.concat_ws(" ", (2005 + F.pmod("n_chars", F.lit(20))).cast("string"), pick(MAKES, F.col("n_chars")), pick(MODELS, F.col("n_chars"))).alias("vehicle_data"),
        status.alias("status"),
        _date(F.col("at")).alias("submission_date"),
        F.when(F.col("k") > 0, _date(F.timestamp_millis(F.unix_millis("at") + 30 * 86400000))).otherwise("").alias("resolution_date"),
    )


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(db_id, html): a detail page for every document, with its first line, second line and rest."""
    d = _documents(spark, sf_dir).withColumn("at", _submitted())

    def text(column: Column) -> Column:
        return F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<tr><td>{label}</td><td>"), text(value), F.lit("</td></tr>"))

    make = F.when(F.pmod("n_chars", F.lit(11)) == 0, "unknown").otherwise(pick(MAKES, F.col("n_chars")))
    kind = F.when(F.pmod("n_chars", F.lit(9)) == 0, pick(TYPES, F.col("number") + 1)).otherwise(pick(TYPES, F.col("number")))
    cells = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", (2005 + F.pmod("n_chars", F.lit(20))).cast("string"), make, pick(MODELS, F.col("n_chars")), pick(BODIES, F.col("n_chars"))), F.lit("</td></tr>"))
    status = F.when(F.col("rest").isNotNull(), "Resolved (Final Response)").otherwise("Submitted to IP")
    html = F.concat(
        F.lit('<html><body><form><table class="widefat"><thead><tr><th>Submitted</th><th>Status</th></tr></thead><tbody><tr><td>'),
        _date(F.col("at")),
        F.lit(" 09:30:00</td><td>"),
        status,
        F.lit('</td></tr></tbody></table><table class="widefat striped"><thead><tr><th>Year</th><th>Make</th><th>Model</th><th>Body</th></tr></thead><tbody>'),
        cells,
        F.lit('</tbody></table><table class="widefat"><tbody>'),
        row("Inquiry type", kind),
        row("Area of Vehicle", _area()),
        row("Issue Summary", F.col("first")),
        row("Suggested Action", F.col("second")),
        row("Resolution", F.col("rest")),
        F.lit("</tbody></table></form></body></html>"),
    )
    return d.select("db_id", html.alias("html"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch outcomes from the events: (run_id, seq, db_id, http_status, reason); a run is a day, an event a page."""
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "view", 302).otherwise(200)
    reason = F.when(F.col("event_type") == "view", F.when(F.pmod("user_id", F.lit(2)) == 0, "soft-404: redirect").otherwise("parse error")).when(F.col("event_type") == "error", "transient")
    return events.select(F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("db_id"), status.alias("http_status"), reason.alias("reason"))


def queue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of past runs from the events, with the columns of the queue."""
    events = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "written").when(F.col("event_type") == "click", "unchanged").when(F.col("event_type") == "error", "queued").otherwise("skipped")
    fields = F.when(F.col("event_type") == "purchase", F.when(F.col("value") < 10, "status,resolution").when(F.col("value") < 40, "resolution").otherwise("make,model,body"))
    return events.select(
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"),
        F.col("event_id").alias("db_id"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "new").otherwise("refresh").alias("pass"),
        state.alias("state"),
        F.lit(1).alias("attempts"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("reason"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 0).alias("changed"),
        fields.alias("changed_fields"),
        F.lit(NOW).alias("updated_at"),
    )

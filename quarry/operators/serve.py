"""From the crawl table to the served corpus, and the corpus as load statements."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import record
from quarry.functions.text import head

C = F.col
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: What a loader that supplies its own transactions rejects.
TRANSACTION = "BEGIN TRANSACTION"
#: Limits of load statements in characters: what one may have, and what packing aims at.
MOST, TARGET = 100_000, 80_000


def parsed_date(text: Column) -> Column:
    """A timestamp in UTC from a date, a date with a time, an ISO instant or month/day/year; else null."""
    bare = F.trim(text)
    day = F.when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(bare, F.lit(" 00:00:00Z")))
    time = F.when(bare.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}"), F.concat(F.translate(F.substring(bare, 1, 19), "T", " "), F.lit("Z")))
    american = F.when(bare.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.concat(bare, F.lit(" Z")))
    return F.coalesce(F.try_to_timestamp(F.coalesce(day, time), F.lit("yyyy-MM-dd HH:mm:ssX")), F.try_to_timestamp(american, F.lit("M/d/yyyy X")))


def _given(column: str) -> Column:
    return F.nullif(C(column), F.lit(""))


def real_resolution() -> Column:
    return F.when(C("resolution") != record.PLACEHOLDER, _given("resolution"))


def title() -> Column:
    kind, area, issue = _given("inquiry_type"), _given("area_of_vehicle"), _given("issue_summary")
    return F.coalesce(F.concat(kind, F.lit(": "), area), kind, head(issue, 80, "..."), F.concat(F.lit("Inquiry "), C("db_id").cast("string")))


def derived(raw: DataFrame) -> DataFrame:
    """Every crawl row with its disposition: delisted, dead, the reason for skipping it, or served."""
    submitted = F.coalesce(parsed_date(C("submission_date")), parsed_date(C("submitted_datetime")))
    issue = F.coalesce(_given("issue_summary"), head(_given("suggested_action"), 200, "..."), head(real_resolution(), 200, "..."))
    status = record.served_status(F.coalesce("status", "resolution_status"))
    rows = raw.withColumns({"submitted_at": submitted, "resolved_at": parsed_date(C("resolution_date")), "issue": issue, "served_status": status})
    held_back = (C("served_status") == "resolved") & (C("resolution") == record.PLACEHOLDER)
    disposition = (
        F.when(C("delisted_at").isNotNull(), "delisted")
        .when(C("dead_at").isNotNull(), "dead")
        .when(C("submitted_at").isNull(), "no submission date")
        .when(_given("source_url").isNull(), "no source url")
        .when(C("issue").isNull() & real_resolution().isNull() & _given("suggested_action").isNull(), "nothing to surface")
        .otherwise("served")
    )
    return rows.withColumns({"disposition": disposition, "served_resolution": F.when(~F.coalesce(held_back, F.lit(False)), _given("resolution")), "derived_issue": _given("issue_summary").isNull() & C("issue").isNotNull()})


def served(raw: DataFrame) -> DataFrame:
    """The served corpus of a crawl table: the 21 columns."""
    metadata = F.to_json(F.struct(C("oem_part_number").alias("oemPartNumber"), C("last_seen_at").alias("lastSeenAt"), C("body_fetched_at").alias("bodyFetchedAt"), _given("issue_summary").isNull().alias("issueSummaryDerived")))
    return derived(raw).filter("disposition = 'served'").select(
        "db_id", C("db_id").cast("string").alias("id"), C("db_id").cast("string").alias("inquiry_number"), title().alias("title"), C("source_url").alias("url"),
        record.one_of(C("database"), record.PROVIDERS).alias("ip"), "inquiry_type", "area_of_vehicle", C("year").alias("vehicle_year"), C("make").alias("vehicle_make"),
        C("model").alias("vehicle_model"), "body", F.lit(None).cast("string").alias("labor_type"), C("issue").alias("issue_summary"), "suggested_action",
        C("served_resolution").alias("resolution"), C("served_status").alias("status"), "submitted_at", "resolved_at",
        F.coalesce("resolved_at", "submitted_at").alias("last_updated"), metadata.alias("metadata"),
    )


#: A URL as the served schema wants it: a scheme, and a host where the scheme has one.
URL = r"^(?i)(?:(?:https?|wss?|ftp)://[^\s/?#]+\S*|(?!(?:https?|wss?|ftp):)[a-z][a-z0-9+.-]*:\S*)$"


def violations() -> Column:
    """What the served schema has against a served row: an array of reasons, empty for a good row."""
    needed = [F.when(C(c).isNull(), F.lit(f"{c} is missing")) for c in ("id", "inquiry_number", "title", "url", "status", "submitted_at", "last_updated", "metadata")]
    listed = [
        F.when(~C("url").rlike(URL), F.lit("url is no address")),
        F.when(~C("ip").isin(*record.PROVIDERS), F.lit("ip is not listed")),
        F.when(~C("status").isin(*record.STATUSES), F.lit("status is not listed")),
        F.when(~C("labor_type").isin(*record.LABOUR_TYPES), F.lit("labor_type is not listed")),
    ]
    return F.array_compact(F.array(*needed, *listed))


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Served rows that fit the schema, and those set apart: (db_id, issue)."""
    told = rows.withColumn("issues", violations())
    good = told.filter(F.size("issues") == 0).drop("issues")
    return good, told.filter(F.size("issues") > 0).select("db_id", F.array_join("issues", "; ").alias("issue"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(db_id, change): ids that one corpus has and the other hasn't."""
    a, b = old.select("db_id", F.lit(1).alias("old")), new.select("db_id", F.lit(1).alias("new"))
    return a.join(b, "db_id", "full_outer").filter("old is null or new is null").select("db_id", F.when(C("old").isNull(), "added").otherwise("removed").alias("change"))


def coerced(rows: DataFrame) -> DataFrame:
    """Served rows as read back: values outside an enumeration become null, an unknown status pending."""
    return rows.withColumns({"ip": record.one_of(C("ip"), record.PROVIDERS), "status": record.one_of(C("status"), ("resolved", "closed"), "pending"), "labor_type": record.one_of(C("labor_type"), record.LABOUR_TYPES)})


def from_rows(rows: DataFrame) -> DataFrame:
    """Table rows as served records: enumerations checked, ISO texts as instants, metadata as a map; what can't be read is null, or an empty map."""
    instants = {c: F.coalesce(*[F.try_to_timestamp(C(c), F.lit(f"yyyy-MM-dd'T'HH:mm:ss{part}X")) for part in (".SSS", "")]) for c in ("submitted_at", "resolved_at", "last_updated")}
    told = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return coerced(rows).withColumns({**instants, "metadata": told})


def to_rows(records: DataFrame) -> DataFrame:
    """Served records as table rows, dates as ISO text; an id that isn't digits is an error."""
    good = C("id").rlike("^[0-9]+$")
    checked = F.when(good, C("id").cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a row id: "), F.coalesce("id", F.lit("null")))).cast("bigint"))
    dates = {c: record.iso(C(c)) for c in ("submitted_at", "resolved_at", "last_updated")}
    return records.withColumns({"db_id": checked, **dates})


def literal(column: Column) -> Column:
    """A value as SQL text: NULL, a number, or a quoted string with its quotes doubled."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def refusal(text: Column) -> Column:
    """What a loader has against a text, or null: control characters, and the phrase that it begins transactions with."""
    return F.when(text.rlike(ILLEGAL), "control character").when(F.contains(text, F.lit(TRANSACTION)), "transaction phrase")


def values_of(rows: DataFrame, numeric: tuple[str, ...] = ("db_id", "vehicle_year")) -> Column:
    """A row as its VALUES tuple."""
    parts = [F.coalesce(C(c).cast("string"), F.lit("NULL")) if c in numeric else literal(C(c)) for c in rows.columns]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def refusals(rows: DataFrame) -> DataFrame:
    """(db_id, reason) of the rows that would fail a load."""
    return rows.select("db_id", refusal(values_of(rows)).alias("reason")).filter("reason is not null")


def insert_values(rows: DataFrame, numeric: tuple[str, ...] = ("db_id", "vehicle_year")) -> DataFrame:
    """(db_id, values, size): each row's VALUES tuple; characters and the phrase that a loader rejects fail the job."""
    text = values_of(rows, numeric)
    stopped = F.raise_error(F.concat(refusal(text), F.lit(" in row "), C("db_id").cast("string")))
    checked = F.when(refusal(text).isNotNull(), stopped).otherwise(text)
    return rows.select("db_id", checked.cast("string").alias("values")).withColumn("size", F.length("values"))


def insert_statements(rows: DataFrame, name: str, lanes: int, target: int = TARGET, most: int = MOST, span: int | None = None) -> DataFrame:
    """(lane, number, statement): INSERTs packed greedily in order of id within each lane.

    A lane is one of ``lanes`` ranges of ids, cut where their numbers of rows are alike, or, given
    a ``span``, the ids from one of its multiples to the next; so lanes are packed side by side,
    and each is one sorted stream that holds the rows of one statement at a time. With one lane
    the order is that of a single file.
    """
    values = insert_values(rows)
    if span is None:
        values = values.repartitionByRange(lanes, "db_id").withColumn("lane", F.spark_partition_id().cast("long"))
    else:
        values = values.withColumn("lane", F.floor(C("db_id") / span)).repartition("lane")
    start = f"INSERT INTO {name} ({', '.join(rows.columns)}) VALUES\n"

    def pack(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list[str] = []
        size, number, lane = len(start), 0, None
        out: list[tuple[int, int, str]] = []

        def closed() -> None:
            nonlocal held, size, number
            if held:
                out.append((lane, number, start + ",\n".join(held) + ";"))
            held, size, number = [], len(start), number + 1

        def told() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["lane", "number", "statement"])
            out.clear()
            return frame

        for batch in batches:
            for at, text in zip(batch["lane"], batch["values"], strict=True):
                if len(start) + len(text) + 2 > most:
                    raise ValueError(f"a row of {len(text)} characters fits no statement")
                if at != lane:
                    closed()
                    lane, number = at, 0
                elif held and size + len(text) + 2 > target:
                    closed()
                held.append(text)
                size += len(text) + 2
            if out:
                yield told()
        closed()
        if out:
            yield told()

    return values.sortWithinPartitions("lane", "db_id").select("lane", "values").mapInPandas(pack, "lane long, number int, statement string")

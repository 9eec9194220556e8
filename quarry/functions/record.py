"""Values derived from one record: providers, vehicles, status, titles, hashes, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record model.
PROVIDERS = ("CCC", "Mitchell", "Audatex")
STATUSES = ("pending", "resolved", "closed")
LABOUR_TYPES = ("body", "paint", "mechanical", "frame", "refinish", "other")
LABOUR_OF_TYPE = {
    "refinish operations": "refinish",
    "body operations": "body",
    "paint operations": "paint",
    "frame": "frame",
    "frame operations": "frame",
    "mechanical": "mechanical",
    "mechanical operations": "mechanical",
}
TWO_WORD_MAKES = ("Land Rover", "Mercedes Benz", "Alfa Romeo", "Aston Martin", "Rolls Royce", "Great Wall")
MAKE_PLACEHOLDERS = ("", "na", "n/a", "none", "unknown", "other", "tbd")
LONGEST_MAKE = 20
PLACEHOLDER = "Awaiting resolution"
HASHED_FIELDS = (
    "status", "resolution_date", "inquiry_type", "area_of_vehicle", "oem_part_number", "issue_summary",
    "suggested_action", "resolution", "year", "make", "model", "body", "submitted_datetime",
)
#: Fixed patterns of a provider in a query: each counts once.
QUERY_PROVIDERS = {
    "CCC": (r"\bmotor\b", r"\bgte\b", r"\bp[\s-]?pages?\b", r"\bccc\b"),
    "Mitchell": (r"\bmitchell\b", r"\bmws\b"),
    "Audatex": (r"\baudatex\b", r"\bdbrm\b", r"\bsolera\b", r"\bqapter\b"),
}
#: Fixed patterns of a provider in a record's text: every occurrence counts.
TEXT_PROVIDERS = {
    "CCC": (r"(?i)\bMOTOR\b", r"(?i)\bGTE Pages?\b", r"(?i)\bP-pages?\b", r"(?i)\bCCC\b"),
    "Mitchell": (r"(?i)\bMitchell DBRM\b", r"(?i)\bMitchell\b", r"(?i)\bMWS\b"),
    "Audatex": (r"(?i)\bAudatex\b", r"(?i)\bDBRM Section\b", r"(?i)\bSolera\b", r"(?i)\bQapter\b"),
}
#: Fixed: blanks as browsers and scripts see them, the no-break space and its kin included.
WIDE_BLANKS = r"[\s   -     　﻿]+"


def collapse(text: Column) -> Column:
    """Runs of blanks, wide ones too, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, WIDE_BLANKS, " "))


def query_provider(query: str) -> str | None:
    """The provider that a query names; none on a tie."""
    lower = query.lower()
    scores = {p: sum(bool(re.search(x, lower, re.ASCII)) for x in patterns) for p, patterns in QUERY_PROVIDERS.items()}
    best = max(scores.values())
    return next(p for p in scores if scores[p] == best) if best and list(scores.values()).count(best) == 1 else None


def text_provider(text: Column) -> Column:
    """The provider named most often in a text; null on a tie or without any."""
    counts = {p: sum((F.regexp_count(text, F.lit(x)) for x in patterns), F.lit(0)) for p, patterns in TEXT_PROVIDERS.items()}
    names = list(counts)

    def pick(n: Column) -> Column:
        best = F.array_max(n)
        alone = F.size(F.filter(n, lambda x: x == best)) == 1
        return F.when((best > 0) & alone, F.get(F.array(*[F.lit(p) for p in names]), F.array_position(n, best).cast("int") - 1))

    return F.transform(F.array(F.array(*[F.coalesce(counts[p], F.lit(0)) for p in names])), pick)[0]


def one_of(column: Column, values: tuple[str, ...], other: str | None = None) -> Column:
    return F.when(column.isin(*values), column).otherwise(F.lit(other))


def lenient_int(text: Column) -> Column:
    """The leading integer of a text, after blanks and a sign; null without one. Of digits beyond 64 bits the first 18 count."""
    return F.coalesce(*[F.regexp_extract(text, rf"^\s*([+-]?[0-9]{most})", 1).try_cast("bigint") for most in ("+", "{1,18}")])


def labour_type(inquiry_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABOUR_OF_TYPE.items() for x in pair])
    return F.try_element_at(table, F.trim(F.lower(inquiry_type)))


def page_status(text: Column) -> Column:
    lower = F.trim(F.lower(text))
    return F.when(F.startswith(lower, F.lit("resolved")), "resolved").when(F.startswith(lower, F.lit("closed")), "closed").otherwise("pending")


def index_status(text: Column) -> Column:
    """resolved or pending, by the start of the status in any case."""
    return F.when(F.startswith(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("resolved")), "resolved").otherwise("pending")


def served_status(text: Column) -> Column:
    """Case-sensitive, and never ``closed``: what is not known counts as pending."""
    return F.when(F.startswith(text, F.lit("Resolved")), "resolved").otherwise("pending")


def vehicle(text: Column) -> Column:
    """struct(year, make, model) of "2019 Land Rover Range Rover"; nulls without a 4-digit year."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def parse(w: Column) -> Column:
        pair = F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2)))
        known = (F.size(w) > 2) & F.lower(pair).isin(*[m.lower() for m in TWO_WORD_MAKES])
        after = F.when(known, 3).otherwise(2)
        rest = F.array_join(F.slice(w, after + 1, F.greatest(F.size(w) - after, F.lit(0))), " ")
        dated = F.get(w, F.lit(0)).rlike("^[0-9]{4}$")
        return F.struct(
            F.when(dated, F.get(w, F.lit(0))).cast("int").alias("year"),
            F.when(dated, F.when(known, pair).otherwise(F.get(w, F.lit(1)))).alias("make"),
            F.when(dated & (F.size(w) > after), rest).alias("model"),
        )

    return F.transform(F.array(words), parse)[0]


def implausible_make(make: Column) -> Column:
    """A make that says nothing, or into which a whole vehicle leaked."""
    bare = F.trim(make)
    return make.isNull() | F.lower(bare).isin(*MAKE_PLACEHOLDERS) | bare.rlike(r"\b[0-9]{4}\b") | (F.length(bare) > LONGEST_MAKE)


def sections(description: Column) -> Column:
    """struct(issue_summary, suggested_action, area_of_vehicle) of a text with Section<N>_<Field> marks; the first non-empty of each wins."""
    found = F.transform(
        F.split(F.concat(F.lit(" "), description), r"(?=\sSection[0-9]+_[A-Za-z0-9_]+\s)"),
        lambda part: F.struct(F.lower(F.regexp_extract(part, r"^\sSection[0-9]+_([A-Za-z0-9_]+)\s", 1)).alias("name"), F.trim(F.regexp_replace(part, r"^\sSection[0-9]+_[A-Za-z0-9_]+\s+", "")).alias("value")),
    )

    def first(name: str) -> Column:
        return F.get(F.filter(found, lambda s: (s["name"] == name) & (s["value"] != "")), F.lit(0))["value"]

    return F.struct(first("issuesummary").alias("issue_summary"), first("suggestedaction").alias("suggested_action"), first("areavehicle").alias("area_of_vehicle"))


def comparable(column: Column) -> Column:
    """The form of a value in hashes and comparisons: null, empty and blank are one."""
    return collapse(F.coalesce(column.cast("string"), F.lit("")))


def content_hash(field=F.col) -> Column:
    """SHA-256 over the names and comparable values of the hashed fields, in their order."""
    parts = [x for name in HASHED_FIELDS for x in (F.lit(f"{name}\x1e"), comparable(field(name)), F.lit("\x1f"))]
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def changed_fields(before, after) -> Column:
    """Names of the hashed fields whose comparable values differ."""
    return F.array_compact(F.array(*[F.when(comparable(before(n)) != comparable(after(n)), F.lit(n)) for n in HASHED_FIELDS]))


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC with milliseconds, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day(ts: Column) -> Column:
    return F.substring(iso(ts), 1, 10)


def us_date(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "M/d/yyyy")


def citation(source_id: str = "quarry", source_name: str = "Quarry Inquiry Gateway", short_name: str = "QIG", noun: str = "inquiry") -> Column:
    """struct of the short and the long form with what they cite; the day is the resolution's, else the submission's."""
    date = F.coalesce(us_date(F.col("resolved_at")), us_date(F.col("submitted_at")), F.lit("date unknown"))
    number = F.concat(F.lit("#"), F.col("id"))
    long = F.concat_ws(", ", F.concat(F.lit(f"{source_name} {noun} "), number), F.concat(F.lit("resolved "), us_date(F.col("resolved_at"))), F.col("url"))
    return F.struct(
        F.concat(F.lit(f"{short_name} "), number, F.lit(" ("), date, F.lit(")")).alias("short_form"),
        long.alias("long_form"),
        F.lit(source_id).alias("source_id"),
        F.lit(source_name).alias("source_name"),
        F.col("id").alias("item_id"),
        F.col("url").alias("url"),
        F.col("submitted_at").alias("published_at"),
        F.col("resolved_at").alias("resolved_at"),
    )


def flattened(short_name: str = "QIG") -> Column:
    """The record as one labelled text; absent and blank fields leave no section."""

    def section(label: str, value: Column) -> Column:
        return F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), F.trim(value)))

    vehicle_ = F.concat_ws(" ", F.when(F.col("vehicle_year") != 0, F.col("vehicle_year").cast("string")), *[F.nullif(F.col(c), F.lit("")) for c in ("vehicle_make", "vehicle_model", "body")])
    return F.concat_ws(
        "\n\n",
        section("Inquiry", F.concat(F.lit(f"{short_name} #"), F.col("inquiry_number"))),
        section("Information provider", F.coalesce("ip", F.lit("not identified"))),
        section("Inquiry type", F.col("inquiry_type")),
        section("Area of vehicle", F.col("area_of_vehicle")),
        section("Vehicle", vehicle_),
        section("Status", F.col("status")),
        section("Issue", F.col("issue_summary")),
        section("Suggested action", F.col("suggested_action")),
        section("Resolution", F.col("resolution")),
    )

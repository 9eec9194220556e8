"""Filters, free-text search, browsing, listing and point lookup over the served corpus."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import record, text

#: Limits of the callers' entry points: least, most, default.
SEARCH_LIMIT, FIND_LIMIT = (1, 50, 10), (1, 20, 5)


def clamped(limit: int | None, bounds: tuple[int, int, int]) -> int:
    least, most, default = bounds
    return default if limit is None else max(least, min(most, limit))


def parsed_filters(filters: dict[str, Any] | None) -> dict[str, Any]:
    """The usable filters; values of a wrong type or outside an enumeration are dropped."""
    out: dict[str, Any] = {}
    for name, value in (filters or {}).items():
        if name == "vehicle_year" and isinstance(value, int) and not isinstance(value, bool):
            out[name] = value
        elif name in ("vehicle_make", "vehicle_model", "inquiry_type") and isinstance(value, str):
            out[name] = value
        elif name == "ip" and value in (*record.PROVIDERS, "unknown"):
            out[name] = value
        elif name == "status" and value in record.STATUSES:
            out[name] = value
    return out


def predicate(filters: dict[str, Any] | None) -> Column:
    """All filters together. Substrings ignore case and know no wildcards; "unknown" is no provider."""
    out = F.lit(True)
    for name, value in parsed_filters(filters).items():
        column = F.col(name)
        if name in ("vehicle_make", "vehicle_model", "inquiry_type"):
            if value:
                out = out & F.contains(F.lower(column), F.lit(value.lower()))
        elif value == "unknown":
            out = out & column.isNull()
        else:
            out = out & (column == value)
    return out


def search(corpus: DataFrame, query: str | None = None, filters: dict[str, Any] | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Records by the share of the query's words they contain, newest first among equals.

    Without a query all records that pass the filters count alike. Records without a word of
    the query are left out. The last key makes the order total.
    """
    asked = bool(query and query.strip())
    score = text.coverage(query) if asked else F.lit(1.0)
    hits = corpus.filter(predicate(filters)).withColumn("score", score)
    if asked:
        hits = hits.filter("score > 0")
    return hits.withColumn("snippet", text.snippet_literal(query or "")).orderBy(F.desc("score"), F.desc("submitted_at"), "db_id").offset(offset).limit(limit)


def list_recent(corpus: DataFrame, since: datetime | str | None = None, limit: int = 10) -> DataFrame:
    """Records newest first, from ``since`` on, that instant included."""
    rows = corpus if since is None else corpus.filter(F.col("submitted_at") >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc("submitted_at"), "db_id").limit(limit)


def get_by_id(corpus: DataFrame, ident: str | int) -> DataFrame:
    """The record with this id; an id that isn't a row of digits has none."""
    ident = str(ident)
    return corpus.filter(F.col("db_id") == int(ident)) if ident.isascii() and ident.isdigit() and int(ident) < 1 << 63 else corpus.filter(F.lit(False))


def find_baseline(corpus: DataFrame, query: str, year: int | None = None, make: str | None = None, model: str | None = None, limit: int = 5) -> DataFrame:
    """Search with the vehicle as filters, its score read as confidence: what support scoring is measured against."""
    filters = {k: v for k, v in (("vehicle_year", year), ("vehicle_make", make), ("vehicle_model", model)) if v is not None}
    return search(corpus, query, filters, limit).withColumnRenamed("score", "confidence")


def hit_payload() -> Column:
    """What a search result shows of a record."""
    return F.struct("id", "title", "url", "score", "snippet", F.col("status"), record.citation()["short_form"].alias("citation"))

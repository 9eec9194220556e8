"""Inquiries read straight from their pages, for samples and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources import fetch, html


def inquiries(ids: DataFrame, get: fetch.Getter, **options) -> tuple[DataFrame, DataFrame]:
    """(db_id) to the served records of the pages that answered, and (db_id, http_status, reason) of the others.

    Both read one fetch each; a caller that needs the two writes the pages first (``of_pages``).
    """
    return of_pages(fetch.fetched(ids, get, **options))


def of_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``inquiries`` returns, of pages that were fetched before."""
    served = F.col("html").isNotNull()
    return html.records(pages.filter(served)), pages.filter(~served).select("db_id", "http_status", "reason")

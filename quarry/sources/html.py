"""Detail pages read into rows: tables of a form, by header or by label.

Spark has no HTML parser, so the markup is tokenised in Arrow batches on the executors; the
values then become columns and every rule about them is an expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import record
from quarry.operators.serve import parsed_date

C = F.col


class _Tables(HTMLParser):
    """Rows of the wide tables inside forms: header names, then cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.forms = self.depth = 0
        self.cell: list[str] | None = None
        self.part = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "form":
            self.forms += 1
        elif tag == "table":
            wide = "widefat" in (dict(attrs).get("class") or "").split()
            if self.depth:
                self.depth += 1
            elif wide and self.forms:
                self.depth = 1
                self.tables.append({"head": [], "rows": []})
        elif self.depth == 1:
            if tag in ("thead", "tbody"):
                self.part = tag
            elif tag == "tr":
                self._close()
                self.tables[-1]["rows"].append([]) if self.part != "thead" else None
            elif tag in ("td", "th"):
                self._close()
                self.cell = []
                self.kind = tag
            elif tag == "br" and self.cell is not None:
                self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "form":
            self.forms = max(0, self.forms - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._close()
                self.part = ""
        elif self.depth == 1:
            if tag in ("td", "th", "tr"):
                self._close()
            elif tag in ("thead", "tbody"):
                self.part = ""

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is None:
            return
        text = " ".join("".join(self.cell).split())
        table = self.tables[-1]
        if self.part == "thead":
            if self.kind == "th":
                table["head"].append(text.lower())
        elif table["rows"]:
            table["rows"][-1].append((self.kind, text))
        self.cell = None


def parsed(html: str | None) -> tuple[dict[str, str], list[str] | None, list[str] | None]:
    """(labels, cells under submitted/status, cells under year/make); the last of a repeated label wins."""
    reader = _Tables()
    reader.feed(html or "")
    reader.close()
    labels: dict[str, str] = {}
    dates = vehicle = None
    for table in reader.tables:
        if table["head"]:
            cells = [t for _, t in table["rows"][0]] if table["rows"] else []
            if {"submitted", "status"} <= set(table["head"]):
                dates = cells
            elif {"year", "make"} <= set(table["head"]):
                vehicle = cells
            continue
        for row in table["rows"]:
            cells = [t for kind, t in row if kind == "td"]
            if len(cells) >= 2 and cells[0]:
                labels[cells[0]] = cells[1]
    return labels, dates, vehicle


def fields(pages: DataFrame, key: str = "db_id", html: str = "html") -> DataFrame:
    """(key, labels, dates, vehicle) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(x) for x in batch.column(1).to_pylist()]
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(r[0].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[1] for r in rows], text), pa.array([r[2] for r in rows], text)], [key, "labels", "dates", "vehicle"]
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, labels map<string,string>, dates array<string>, vehicle array<string>")


def details(pages: DataFrame, key: str = "db_id", html: str = "html") -> DataFrame:
    """The rows of detail pages, with the fields of a crawl row."""
    got = fields(pages, key, html)

    def label(name: str):
        return F.try_element_at(C("labels"), F.lit(name))

    old = record.sections(F.coalesce(label("Description"), F.lit("")))

    def either(name: str, field: str):
        return F.coalesce(F.nullif(label(name), F.lit("")), old[field], label(name))

    answer = F.nullif(label("Resolution"), F.lit(""))
    digits = F.regexp_replace(F.get(C("vehicle"), F.lit(0)), r"\D", "")
    return got.select(
        key,
        label("Inquiry type").alias("inquiry_type"),
        either("Area of Vehicle", "area_of_vehicle").alias("area_of_vehicle"),
        label("OEM Part Number").alias("oem_part_number"),
        either("Issue Summary", "issue_summary").alias("issue_summary"),
        either("Suggested Action", "suggested_action").alias("suggested_action"),
        F.coalesce(answer, F.lit(record.PLACEHOLDER)).alias("resolution"),
        F.when(answer.isNull(), "pending").otherwise("resolved").alias("resolution_status"),
        F.substring(digits, 1, 9).try_cast("int").alias("year"),
        F.get(C("vehicle"), F.lit(1)).alias("make"),
        F.get(C("vehicle"), F.lit(2)).alias("model"),
        F.get(C("vehicle"), F.lit(3)).alias("body"),
        F.get(C("dates"), F.lit(0)).alias("submitted_datetime"),
        F.get(C("dates"), F.lit(1)).alias("status_raw"),
        label("Tracking #").alias("tracking"),
    )


def records(pages: DataFrame, key: str = "db_id", html: str = "html") -> DataFrame:
    """The same pages as served records: provider from the texts, labour type, status and dates."""
    d = details(pages, key, html)
    answer = F.when(C("resolution_status") == "resolved", C("resolution"))
    released = F.regexp_extract(answer, r"(?i)Estimated Release Date:\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})", 1)
    nothing = F.lit("")
    vehicle = F.concat_ws(" ", C("year").cast("string"), F.nullif(C("make"), nothing), F.nullif(C("model"), nothing))
    topic = F.concat_ws(": ", F.nullif(C("inquiry_type"), nothing), F.nullif(C("area_of_vehicle"), nothing))
    number = F.coalesce("tracking", C(key).cast("string"))
    return d.withColumns(
        {
            "inquiry_number": number,
            "title": F.coalesce(F.nullif(F.concat_ws(" — ", F.nullif(vehicle, nothing), F.nullif(topic, nothing)), nothing), F.concat(F.lit("Inquiry "), number)),
            "ip": record.text_provider(F.concat_ws("\n", answer, F.nullif(C("issue_summary"), nothing), F.nullif(C("suggested_action"), nothing))),
            "labor_type": record.labour_type(C("inquiry_type")),
            "status": record.page_status(F.coalesce("status_raw", nothing)),
            "submitted_at": parsed_date(C("submitted_datetime")),
            "resolved_at": parsed_date(released),
        }
    ).withColumn("last_updated", F.coalesce("resolved_at", "submitted_at"))

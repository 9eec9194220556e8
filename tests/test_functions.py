from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import freshness, record, text

C = F.col


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "norm"), [("R&I  rear", "ri rear"), ("R & I", "ri"), ("A&B&C", "ab c"), ("two-tone, blend!", "two tone blend"), ("Été", "t"), ("", ""), ("  ", "")])
def test_normalisation(spark, raw, norm):
    assert text.normalised(raw) == norm
    assert one(spark, text.normalise(C("x")), x=raw) == norm


def test_tokens_and_bigrams(spark):
    query = "Blend the two-tone refinish of a R&I"
    assert text.query_tokens(query) == ["blend", "two", "tone", "refinish", "ri"]
    assert one(spark, text.tokens(C("x")), x=query) == text.query_tokens(query)
    assert one(spark, text.bigrams(text.tokens(C("x"))), x=query) == text.pairs_of(text.query_tokens(query))
    assert one(spark, text.bigrams(text.tokens(C("x"))), x="blend") == []
    assert one(spark, text.tokens(C("x")), x="the of and") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ09 &-_.,\n", max_size=30))
def test_normalisation_agrees_on_both_sides(spark, raw):
    assert one(spark, text.normalise(C("x")), x=raw) == text.normalised(raw)


@pytest.mark.parametrize(
    ("query", "found"),
    [("MOTOR guide", "CCC"), ("p-pages and mitchell", None), ("ccc motor vs mitchell", "CCC"), ("dbrm", "Audatex"), ("mws", "Mitchell"), ("bumper", None), ("motorcycle", None), ("ppages", "CCC")],
)
def test_provider_of_query(query, found):
    assert record.query_provider(query) == found


@pytest.mark.parametrize(
    ("raw", "found"),
    [("Mitchell Mitchell, CCC", "Mitchell"), ("Mitchell and CCC", None), ("DBRM alone", None), ("see DBRM Section", "Audatex"), ("nothing", None), ("GTE Pages, MOTOR", "CCC")],
)
def test_provider_of_text(spark, raw, found):
    assert one(spark, record.text_provider(C("x")), x=raw) == found


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2019 Land Rover Range Rover", (2019, "Land Rover", "Range Rover")),
        ("2019 LAND rover", (2019, "LAND rover", None)),
        ("2020 Ford F 150", (2020, "Ford", "F 150")),
        ("2020 Ford", (2020, "Ford", None)),
        ("2020", (2020, None, None)),
        ("Ford 2020", (None, None, None)),
        ("", (None, None, None)),
        ("20201 Ford", (None, None, None)),
        ("  2018   Great  Wall   H6 ", (2018, "Great Wall", "H6")),
    ],
)
def test_vehicle(spark, raw, want):
    assert tuple(one(spark, record.vehicle(C("x")), x=raw)) == want


@pytest.mark.parametrize(("raw", "want"), [("41x", 41), (" 42", 42), ("-7 ", -7), ("x41", None), ("", None), ("0042", 42), ("9" * 30, 10**18 - 1)])
def test_lenient_int(spark, raw, want):
    assert one(spark, record.lenient_int(C("x")), x=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("NA", True), ("2020 Rang Rover Ecoque P250", True), ("Mercedes Benz", False), ("", True), ("a make of far too many letters", True), ("Ford", False)])
def test_implausible_make(spark, raw, want):
    assert one(spark, record.implausible_make(C("x")), x=raw) is want


def test_sections_first_wins(spark):
    raw = "Section6_IssueSummary the issue Section6_SuggestedAction do it Section3_IssueSummary again Section6_AreaVehicle Roof"
    assert tuple(one(spark, record.sections(C("x")), x=raw)) == ("the issue", "do it", "Roof")
    assert tuple(one(spark, record.sections(C("x")), x="no marks")) == (None, None, None)


def test_hash_ignores_blanks_and_nulls_but_not_case_or_field(spark):
    names = ", ".join(f"{n} {'int' if n == 'year' else 'string'}" for n in record.HASHED_FIELDS)
    base = dict.fromkeys(record.HASHED_FIELDS)
    rows = [base | {"issue_summary": "a  b"}, base | {"issue_summary": " a b\n", "resolution": ""}, base | {"issue_summary": "A b"}, base | {"resolution": "a b"}, base | {"issue_summary": "a b", "year": 2020}]
    got = [r[0] for r in spark.createDataFrame([tuple(r.values()) for r in rows], names).select(record.content_hash()).collect()]
    want = hashlib.sha256("".join(f"{n}\x1e{'a b' if n == 'issue_summary' else ''}\x1f" for n in record.HASHED_FIELDS).encode()).hexdigest()
    assert got[0] == got[1] == want
    assert len(set(got)) == 4


FIRES = ["any recent rulings", "latest on blend", "newer panels", "newest", "what's new", "whats new", "anything new here", "currently open", "current", "up-to-date list", "up to date", "lately", "so far", "to date", "this year", "last month", "past 30 days", "today", "right now", "since 2026", "2030 model"]
QUIET = ["new quarter panel", "blend two-tone refinish", "quarter panel", "renewal", "2019 Silverado", "recency bias", "the past", "a later date", "", "newish", "currents"]


@pytest.mark.parametrize("query", FIRES)
def test_recency_fires(spark, query):
    assert freshness.implies_recency(query, 2026)
    assert one(spark, freshness.recency_asked(C("x"), F.lit(2026)), x=query)


@pytest.mark.parametrize("query", QUIET)
def test_recency_stays_quiet(spark, query):
    assert not freshness.implies_recency(query, 2026)
    assert not one(spark, freshness.recency_asked(C("x"), F.lit(2026)), x=query)


def corpus_of(spark, rows):
    data = spark.createDataFrame(rows, "submitted string, resolved string, metadata string")
    return data.select(C("submitted").cast("timestamp").alias("submitted_at"), C("resolved").cast("timestamp").alias("resolved_at"), "metadata")


def test_freshness_is_whole_or_nothing(spark):
    assert freshness.summary(corpus_of(spark, [])).collect() == []
    assert freshness.summary(corpus_of(spark, [("2020-01-01", None, "{}")])).collect() == []
    odd = [("2020-01-01", None, '{"lastSeenAt": "soon", "scrapedAt": "2024-05-01T00:00:00Z"}'), ("2020-02-01", "2021-01-01", '{"lastSeenAt": 42, "bodyFetchedAt": "2025-05-01"}')]
    assert tuple(freshness.summary(corpus_of(spark, odd)).first()) == ("2021-01-01", "2024-05-01", 2)
    both = [("2020-01-01", None, '{"lastSeenAt": "2023-01-01"}'), ("2020-02-01", None, '{"scrapedAt": "2024-01-01"}')]
    assert freshness.summary(corpus_of(spark, both)).first()["synced_at"] == "2023-01-01"


def test_pairs_round_trip_and_refuse_halves(spark):
    rows = freshness.as_pairs(freshness.summary(corpus_of(spark, [("2020-01-01", None, '{"lastSeenAt": "2023-01-01"}')])))
    assert tuple(freshness.from_pairs(rows).first()) == ("2020-01-01", "2023-01-01", 1)
    for broken in ([("currentThrough", "2020-01-01"), ("syncedAt", "2023-01-01")], [("currentThrough", "x"), ("syncedAt", "2023-01-01"), ("recordCount", "3")], [("currentThrough", "2020-01-01"), ("syncedAt", "2023-01-01"), ("recordCount", "0")]):
        assert freshness.from_pairs(spark.createDataFrame(broken, "key string, value string")).collect() == []


def test_notes_name_the_cutoff():
    known = freshness.Freshness("2026-07-31", "2026-08-02", 22652)
    assert "22,652" in freshness.sentence(known, "inquiries")
    assert freshness.recency_note(known, "inquiries").startswith("Inquiries dated after 2026-07-31")
    assert freshness.beyond("2026-08-10T00:00:00Z", known) and not freshness.beyond("2026-07-31", known) and not freshness.beyond(None, known)


def test_citation_days_do_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.range(1).select(F.lit("7").alias("id"), F.lit("u").alias("url"), F.timestamp_millis(F.lit(1767225600000)).alias("submitted_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
            assert rows.select(record.citation()["short_form"]).first()[0] == "QIG #7 (1/1/2026)"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_snippets(spark):
    values = {"issue_summary": "x" * 100 + " needle " + "y" * 300, "resolution": "Needle two", "suggested_action": None}
    schema = "issue_summary string, resolution string, suggested_action string"
    df = spark.createDataFrame([tuple(values.values())], schema)
    cut = df.select(text.snippet_literal("NEEDLE")).first()[0]
    assert cut.startswith("…") and cut.endswith("…") and len(cut) == 2 + 60 + 6 + 120
    assert df.select(text.snippet_literal("two")).first()[0] == "Needle two"
    assert df.select(text.snippet_literal("absent")).first()[0] == values["issue_summary"][:200] + "…"
    assert df.select(text.snippet_literal("")).first()[0] == values["issue_summary"][:120] + "…"
    assert df.select(text.snippet_token("the two needle")).first()[0] == cut

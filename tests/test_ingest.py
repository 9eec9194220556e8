from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import record
from quarry.operators import dml, reports, serve, sync
from quarry.sources import fetch, html, sinks, tables, views
from quarry.streaming import ingest

C = F.col
NOW = "2026-05-07T12:00:00.000Z"


def raw(spark, *rows):
    names = [f.name for f in tables.RAW.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], tables.RAW)


def live(spark, *rows):
    return spark.createDataFrame(list(rows), "db_id long, status string, resolution_date string")


def ids(df):
    return sorted(r["db_id"] for r in df.collect())


def entries(spark, *rows):
    names = ("pos", "db_id", "database", "inquiry_type", "vehicle_data", "status", "submission_date", "resolution_date")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], "pos long, " + ", ".join(f"{n} string" for n in names[1:]))


def test_last_entry_wins_and_ids_are_lenient(spark):
    rows = entries(spark, {"pos": 0, "db_id": "41x", "status": "a"}, {"pos": 1, "db_id": "41", "status": "b"}, {"pos": 2, "db_id": "x", "status": "c"}, {"pos": 3, "db_id": None})
    assert [(r["db_id"], r["status"]) for r in sync.deduplicated(rows).collect()] == [(41, "b")]


def test_cohorts(spark):
    held = raw(
        spark,
        {"db_id": 1, "status": "Resolved", "resolution_date": "2026-01-01", "resolution_status": "resolved", "resolution": "text"},
        {"db_id": 2, "status": "Submitted to IP", "resolution_status": "pending"},
        {"db_id": 3, "status": "Resolved", "resolution_status": "resolved", "resolution": "Awaiting resolution", "resolution_date": "2026-04-01"},
        {"db_id": 4, "status": "Resolved", "resolution_status": "resolved", "resolution": "", "resolution_date": "2009-04-01"},
        {"db_id": 5, "status": "Resolved", "resolution_status": "resolved", "resolution": "x", "delisted_at": "t"},
        {"db_id": 6, "status": "Resolved", "resolution_status": "resolved", "resolution": "x", "dead_suspected_at": "t", "delisted_at": "t"},
        {"db_id": 7, "status": "Submitted to IP", "resolution_status": "pending", "dead_suspected_at": "t", "dead_at": "t"},
        {"db_id": 8, "status": "Resolved", "resolution_status": "resolved", "resolution": "x"},
    )
    now = live(spark, (1, " Resolved ", "2026-01-02"), (2, "Submitted to IP", None), (3, "Resolved", "2026-04-01"), (4, "Resolved", "2009-04-01"), (5, "Resolved", ""), (7, "Submitted to IP", ""), (9, "new", ""), (6, "Resolved", ""))
    assert ids(sync.new_ids(now, held)) == [9]
    assert ids(sync.changed_ids(now, held)) == [1]
    assert ids(sync.delisted_ids(now, held)) == [8]
    assert ids(sync.reappeared_ids(now, held)) == [5, 6]
    assert ids(sync.unresolved_ids(held)) == [2]
    assert ids(sync.blank_resolved_ids(held, "2026-05-07")) == [3]
    assert ids(sync.suspected_ids(held)) == [6]
    assert ids(sync.trailing_ids(held, 2)) == [4, 8]
    queue = sync.queue(now, held, "2026-05-07", 2).orderBy(*sync.queue_order()).collect()
    assert [tuple(r) for r in queue] == [("new", 9), ("refresh", 1), ("refresh", 2), ("refresh", 3), ("refresh", 4), ("refresh", 6)]
    assert ids(sync.queue(now, held, "2026-05-07", 2, index_only=True)) == [1, 6, 9]


def test_report_and_queue_count_blank_rows_over_the_same_year(spark):
    days = {1: "2025-05-06", 2: "2025-05-07", 3: "2024-05-07", 4: None, 5: "2026-04-01"}
    held = raw(spark, *[{"db_id": n, "status": "Resolved", "resolution_status": "resolved", "resolution": "", "resolution_date": day} for n, day in days.items()])
    now = live(spark, *[(n, "Resolved", day) for n, day in days.items()])
    report = {r["cohort"]: tuple(r)[1:] for r in reports.cohorts(now, held, views.TODAY, 0).collect()}
    assert report["blank"] == report["queue"] == (3, 2, 5)  # 365 days back from 2026-05-07, that day included


@pytest.mark.parametrize(("held", "got", "gone", "ok"), [(1000, 900, 0, True), (1000, 899, 0, False), (0, 0, 0, True)])
def test_sanity_share(spark, held, got, gone, ok):
    h = raw(spark, *[{"db_id": i, "delisted_at": None} for i in range(held)])
    rows = live(spark, *[(i, "", "") for i in range(got)])
    row = sync.plan_sanity(rows, h).first()
    assert row["covered"] is ok


def test_sanity_cap_and_refusal(spark):
    h = raw(spark, *[{"db_id": i} for i in range(600)])
    assert sync.plan_sanity(live(spark, *[(i, "", "") for i in range(550)]), h).first()["ok"]
    assert not sync.plan_sanity(live(spark, *[(i, "", "") for i in range(549)]), h).first()["ok"]
    with pytest.raises(sync.ImplausibleSnapshot):
        sync.require_sane(live(spark, (1, "", "")), h)


def test_upsert_keeps_vehicles_and_forgets_moved_pages(spark):
    held = raw(
        spark,
        {"db_id": 1, "status": "a", "resolution_date": "d", "make": "Kept", "body_fetched_at": "t", "issue_summary": "x"},
        {"db_id": 2, "status": "a", "resolution_date": None, "body_fetched_at": "t"},
        {"db_id": 3, "status": "a", "resolution_date": "d", "body_fetched_at": "t"},
        {"db_id": 4, "status": "a", "body_fetched_at": "t"},
    )
    feed = entries(spark, *[{"pos": i, "db_id": str(i), "vehicle_data": "2020 Ford Focus", "status": "b" if i == 3 else "a", "resolution_date": "d", "submission_date": "s"} for i in (1, 2, 3, 9)])
    got = {r["db_id"]: r for r in dml.upserted(held, dml.metadata_rows(sync.deduplicated(feed), NOW)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 9]
    assert got[1]["make"] == "Kept" and got[1]["model"] == "Focus" and got[1]["issue_summary"] == "x" and got[1]["body_fetched_at"] == "t"
    assert got[2]["body_fetched_at"] == "t"  # a comparison with null is no move
    assert got[3]["body_fetched_at"] is None and got[4]["status"] == "a"
    assert got[9]["source_url"].endswith("/9/") and got[9]["year"] == 2020


def page(spark, **values):
    row = dict.fromkeys(dml.PAGE_FIELDS) | {"resolution": "Awaiting resolution", "resolution_status": "pending"} | values
    return spark.createDataFrame([(1, *[row[n] for n in dml.PAGE_FIELDS])], "db_id long, " + ", ".join(f"{n} {'int' if n == 'year' else 'string'}" for n in dml.PAGE_FIELDS))


@pytest.mark.parametrize(
    ("stored", "fetched", "outcome", "changed"),
    [
        ({"issue_summary": "a"}, {"issue_summary": "b"}, "written", "issue_summary,resolution"),
        ({"issue_summary": "a b", "resolution": "Awaiting resolution"}, {"issue_summary": "a  b"}, "unchanged", None),
        ({"issue_summary": "a"}, {}, "skipped", None),
        ({"inquiry_type": "", "issue_summary": "a"}, {}, "written", "resolution"),  # an empty type hides the summary
        ({"issue_summary": "a", "make": "Ford"}, {"issue_summary": "a", "make": "2020 Ford Focus", "resolution": "r"}, "written", "resolution"),
        ({"issue_summary": "a", "resolution": "old"}, {"issue_summary": "", "inquiry_type": "t"}, "written", "inquiry_type,issue_summary,resolution"),
    ],
)
def test_refresh(spark, stored, fetched, outcome, changed):
    row = dml.refreshed(raw(spark, {"db_id": 1} | stored), page(spark, **fetched), NOW).first()
    assert (row["outcome"], row["changed_fields"]) == (outcome, changed)
    assert (row["content_hash"] is None) is (outcome == "skipped")
    assert row["make"] == stored.get("make")


def test_refresh_short_cut_by_hash(spark):
    first = dml.refreshed(raw(spark, {"db_id": 1, "issue_summary": "a"}), page(spark, issue_summary="b"), NOW)
    again = dml.refreshed(first.select(*dml.RAW), page(spark, issue_summary="b"), "later").first()
    assert again["outcome"] == "unchanged" and again["body_fetched_at"] == NOW


def test_backfill_keeps_type_and_vehicle(spark):
    row = dml.backfilled(raw(spark, {"db_id": 1, "inquiry_type": "kept", "make": "Kept", "issue_summary": "old"}), page(spark, inquiry_type="t", make="M", issue_summary="new", year=2020), NOW).first()
    assert (row["inquiry_type"], row["make"], row["issue_summary"], row["year"], row["body_fetched_at"]) == ("kept", "Kept", "new", 2020, NOW)


def test_repair_is_idempotent_and_keeps_case(spark):
    held = raw(spark, {"db_id": 1, "make": "LAND", "model": "Rover Range"}, {"db_id": 2, "make": "Alfa", "model": "romeo"}, {"db_id": 3, "make": "Land", "model": "Roverine"}, {"db_id": 4, "make": None, "model": None})
    once = dml.repaired_makes(held)
    got = {r["db_id"]: (r["make"], r["model"], r["repaired"]) for r in once.collect()}
    assert got == {1: ("LAND Rover", "Range", "Land Rover"), 2: ("Alfa romeo", None, "Alfa Romeo"), 3: ("Land", "Roverine", None), 4: (None, None, None)}
    assert dml.repaired_makes(once).filter("repaired is not null").count() == 0


def outcomes(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id long, seq long, db_id long, http_status int, reason string")


def test_breaker(spark):
    bad = [(1, i, i, 503, None) for i in range(4)] + [(1, 4, 4, 404, None)] + [(1, i, i, 0, None) for i in range(5, 15)]
    row = sync.breaker(outcomes(spark, *bad, (2, 0, 0, 429, None))).orderBy("run_id").collect()
    assert [tuple(r) for r in row] == [(1, 14, 10), (2, None, 1)]


def test_two_strikes_and_marks(spark):
    o = outcomes(spark, (1, 0, 1, 404, None), (1, 0, 2, 404, None), (2, 1, 2, 302, "soft-404: x"), (1, 0, 3, 404, None), (2, 1, 3, 200, None), (3, 2, 3, 404, None), (1, 0, 4, 200, None), (1, 0, 5, 302, "parse error"), (1, 0, 6, 404, None))
    s = sync.two_strikes(o)
    assert {r["db_id"]: r["state"] for r in s.collect()} == {1: "suspected", 2: "dead", 3: "suspected", 4: "alive", 5: "alive", 6: "suspected"}
    held = raw(spark, *[{"db_id": i} for i in (1, 2, 3)], {"db_id": 4, "dead_suspected_at": "t", "dead_at": "t"}, {"db_id": 5, "dead_suspected_at": "t"}, {"db_id": 6, "dead_suspected_at": "t"}, {"db_id": 7, "dead_suspected_at": "t"})
    got = {r["db_id"]: (r["dead_suspected_at"], r["dead_at"]) for r in dml.marked_dead(held, s, NOW).collect()}
    assert got == {1: (NOW, None), 2: (NOW, NOW), 3: (NOW, None), 4: (None, None), 5: ("t", None), 6: ("t", NOW), 7: ("t", None)}


def test_queue_is_idempotent_and_counts_attempts(spark):
    empty = spark.createDataFrame([], "run_id long, db_id long, pass string, state string, attempts int, http_status int, reason string, changed int, changed_fields string, updated_at string")
    queue = spark.createDataFrame([("new", 1), ("refresh", 2)], "pass string, db_id long")
    items = dml.enqueued(dml.enqueued(empty, 5, queue, NOW), 5, queue, NOW)
    assert items.count() == 2
    found = spark.createDataFrame([(5, 1, "transient", 503, "x", None, None), (5, 2, "written", 200, None, 1, "make")], "run_id long, db_id long, state string, http_status int, reason string, changed int, changed_fields string")
    got = {r["db_id"]: (r["state"], r["attempts"]) for r in dml.recorded(items, found, NOW).collect()}
    assert got == {1: ("queued", 1), 2: ("written", 1)}
    assert [r["db_id"] for r in ingest.drain(items, 1).collect()] == [1]


def test_transform_rules(spark):
    base = {"status": "Resolved (x)", "submission_date": "2020-01-02", "source_url": "u", "issue_summary": "i", "database": "CCC"}
    held = raw(
        spark,
        base | {"db_id": 1, "resolution": "Awaiting resolution", "resolution_date": "2020-02-03"},
        base | {"db_id": 2, "status": "resolved", "resolution": "Awaiting resolution", "database": "Other"},
        base | {"db_id": 3, "submission_date": "", "submitted_datetime": "2020-01-02 10:11:12"},
        base | {"db_id": 4, "submission_date": None},
        base | {"db_id": 5, "source_url": None},
        base | {"db_id": 6, "issue_summary": "", "suggested_action": "s" * 300},
        base | {"db_id": 7, "issue_summary": None, "resolution": "Awaiting resolution"},
        base | {"db_id": 8, "delisted_at": "t", "dead_at": "t"},
        base | {"db_id": 9, "dead_at": "t"},
        base | {"db_id": 10, "inquiry_type": "T", "area_of_vehicle": "A"},
    )
    kinds = {r["db_id"]: r["disposition"] for r in serve.derived(held).collect()}
    assert kinds == {1: "served", 2: "served", 3: "served", 4: "no submission date", 5: "no source url", 6: "served", 7: "nothing to surface", 8: "delisted", 9: "dead", 10: "served"}
    got = {r["db_id"]: r for r in serve.to_rows(serve.served(held)).collect()}
    assert got[1]["resolution"] is None and got[1]["status"] == "resolved" and got[1]["last_updated"] == "2020-02-03T00:00:00.000Z"
    assert got[2]["status"] == "pending" and got[2]["resolution"] == "Awaiting resolution" and got[2]["ip"] is None  # the match is case-sensitive
    assert got[3]["submitted_at"] == "2020-01-02T10:11:12.000Z" and got[6]["issue_summary"] == "s" * 200 + "..." and got[10]["title"] == "T: A"
    assert json.loads(got[6]["metadata"])["issueSummaryDerived"] is True


def test_rows_refuse_odd_ids_and_control_characters(spark):
    served = serve.served(raw(spark, {"db_id": 1, "submission_date": "2020-01-01", "source_url": "u", "issue_summary": "it's"}))
    with pytest.raises(Exception, match="not a row id"):
        serve.to_rows(served.withColumn("id", F.lit("4x"))).collect()
    with pytest.raises(Exception, match="control character"):
        serve.insert_values(served.select("db_id", F.lit("a\x01").alias("title"))).collect()
    assert serve.insert_values(served.select("db_id", "issue_summary", "resolution")).first()["values"] == "(1, 'it''s', NULL)"


def test_rows_refuse_the_transaction_phrase(spark):
    row = spark.range(1).select(C("id").alias("db_id"), F.lit("to BEGIN TRANSACTION now").alias("title"))
    with pytest.raises(Exception, match="transaction phrase in row 0"):
        serve.insert_values(row).collect()


def test_load_statements_pack_all_served_columns(spark):
    from quarry.queries import load_statements
    from quarry.sources import views

    d = "/root/testdata/sf0.001"
    sizes = [r["size"] for r in load_statements(spark, d).collect()]
    text = views.corpus(spark, d).select(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in ("title", "body", "issue_summary", "suggested_action", "resolution")), F.lit(0)))).first()[0]
    assert sum(sizes) > text


def test_statements_pack_to_the_target(spark):
    rows = spark.range(100).select(C("id").alias("db_id"), F.lit("x" * 50).alias("title"))
    got = serve.insert_statements(rows, "t", 1, target=1000).collect()
    assert sum(r["statement"].count("x" * 50) for r in got) == 100 and max(len(r["statement"]) for r in got) <= 1001
    with pytest.raises(Exception, match="fits no statement"):
        serve.insert_statements(rows, "t", 1, most=40).collect()


PAGE = """<form><table class="widefat"><thead><tr><th>Submitted</th><th>Status</th></tr></thead><tbody><tr><td>2026-04-08 12:14:58</td><td>Resolved</td></tr></tbody></table>
<table class="x widefat"><thead><tr><th>Year</th><th>Make</th><th>Model</th><th>Body</th></tr></thead><tbody><tr><td>2020*</td><td>Ford</td><td>F-150</td><td>Cab</td></tr></tbody></table>
<table class="widefat"><tbody><tr><td>Inquiry type</td><td>Refinish Operations</td></tr><tr><td>Issue Summary</td><td>one<br/>two &amp; three</td></tr><tr><td>x</td></tr>
<tr><td>Resolution</td><td>{0}</td></tr><tr><td>Description</td><td>Section6_IssueSummary old Section6_AreaVehicle Roof</td></tr></tbody></table></form><table class="widefat"><tbody><tr><td>Resolution</td><td>outside</td></tr></tbody></table>"""


def test_detail_page(spark):
    rows = [(1, PAGE.format("Mitchell says so. Estimated Release Date: 5/6/2026")), (2, PAGE.format("")), (3, None), (4, "<form><table class='widefat'><tr><td>unclosed")]
    got = {r["db_id"]: r for r in html.records(spark.createDataFrame(rows, "db_id long, html string")).collect()}
    one = got[1]
    assert (one["year"], one["make"], one["model"], one["body"], one["issue_summary"], one["area_of_vehicle"]) == (2020, "Ford", "F-150", "Cab", "one two & three", "Roof")
    assert (one["ip"], one["labor_type"], one["status"], one["title"]) == ("Mitchell", "refinish", "resolved", "2020 Ford F-150 — Refinish Operations: Roof")
    assert record.iso is not None and str(one["resolved_at"]).startswith("2026-05-06")
    assert got[2]["resolution"] == "Awaiting resolution" and got[2]["resolution_status"] == "pending" and got[2]["resolved_at"] is None
    assert got[3]["issue_summary"] is None and got[4]["resolution_status"] == "pending"


def test_readers(spark, tmp_path):
    with pytest.raises(tables.MissingTable):
        tables.opened(spark, str(tmp_path / "none"), tables.RAW)
    assert tables.opened(spark, str(tmp_path / "none"), tables.RAW, create=True).count() == 0
    assert tables.pairs(spark, str(tmp_path / "none")).count() == 0
    old = str(tmp_path / "old")
    raw(spark, {"db_id": 1}).drop("dead_at").write.parquet(old)
    assert tables.opened(spark, old, tables.RAW).first()["dead_at"] is None
    good = {"db_id": 1, "id": "1", "inquiry_number": "1", "title": "t", "url": "u", "status": "pending", "submitted_at": "2020-01-01T00:00:00Z", "last_updated": "2020-01-01T00:00:00Z", "metadata": "{}"}
    (tmp_path / "c.json").write_text(json.dumps([good, good]))
    assert tables.corpus_file(spark, str(tmp_path / "c.json")).count() == 2
    for broken in ({k: v for k, v in good.items() if k != "title"}, good | {"db_id": "many"}):
        (tmp_path / "bad.json").write_text(json.dumps([good, broken]))
        with pytest.raises(Exception, match="title is missing|MALFORMED|FAILED_READ"):
            tables.corpus_file(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "i.json").write_text(json.dumps({"count": 2, "data": [{"db_id": "5", "status": "a", "more": {"x": 1}}, {"db_id": "5", "status": "b"}]}))
    assert [(r["pos"], r["status"]) for r in tables.index_snapshot(spark, str(tmp_path / "i.json")).collect()] == [(0, "a"), (1, "b")]


def test_high_water(spark):
    held = raw(spark, {"db_id": 4}, {"db_id": 9})
    assert tuple(reports.high_water(held).first()) == (9, "derived")
    mark = spark.createDataFrame([("last_id", "7")], tables.PAIRS)
    assert tuple(reports.high_water(held, mark).first()) == (7, "stored")
    assert tuple(reports.high_water(raw(spark)).first()) == (0, "derived")
    assert {r["key"]: r["value"] for r in dml.pairs_upserted(mark, spark.createDataFrame([("last_id", "8"), ("x", "1")], tables.PAIRS)).collect()} == {"last_id": "8", "x": "1"}


def test_stream_of_snapshots(spark, tmp_path):
    landing, store = str(tmp_path / "in"), ingest.Store(spark, str(tmp_path / "table"))

    def land(*rows):
        made = spark.createDataFrame([(str(i), None, "CCC", "T", "2020 Ford Focus", s, "2020-01-01", d, k) for k, (i, s, d) in enumerate(rows)], ingest.ENTRY)
        made.coalesce(1).write.mode("append").parquet(landing)

    def run():
        query = ingest.start(spark, landing, store, str(tmp_path / "cp"), lambda: NOW)
        query.awaitTermination()

    land(*[(i, "Submitted to IP", "") for i in range(20)], (3, "Resolved", "2020-02-02"))
    run()
    assert store.read().count() == 20 and store.versions() == [1]
    land(*[(i, "Resolved", "2020-03-03") for i in range(1, 21)])
    run()
    rows = {r["db_id"]: r for r in store.read().collect()}
    assert store.versions() == [1, 2] and len(rows) == 21 and rows[0]["delisted_at"] == NOW and rows[5]["resolution_status"] == "resolved"
    run()
    assert store.versions() == [1, 2]
    land((1, "x", ""))
    with pytest.raises(Exception, match="covers 1 of"):
        run()
    assert store.versions() == [1, 2]


def test_fetch_tries_again_and_tells_what_is_gone():
    pauses = []

    def run(*answers, retries=2):
        left = list(answers)

        def get(url):
            got = left.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return fetch.fetch(7, get, retries=retries, sleep=pauses.append)

    here = "https://inquiries.example/7/"
    assert run(fetch.Answer(503, here), OSError("reset"), fetch.Answer(200, here, "page")) == (200, None, "page")
    assert pauses == [10.0, 20.0]
    assert run(fetch.Answer(404, here))[:2] == (404, "not found")
    assert run(fetch.Answer(200, "https://inquiries.example/list/"))[1].startswith("soft-404")
    assert run(*[fetch.Answer(500, here)] * 3)[:2] == (500, "gave up after 2 retries on status 500")
    assert run(*[OSError("x")] * 3)[0] == 0
    assert run(fetch.Answer(403, here))[:2] == (403, "unexpected status")


def test_fetched_pages_feed_the_state_machines(spark):
    def get(url):
        number = int(url.rstrip("/").rpartition("/")[2])
        return fetch.Answer(404 if number % 3 == 0 else 200, url, f"<p>{number}</p>")

    got = fetch.fetched(spark.range(9).withColumnRenamed("id", "db_id").repartition(2), get, pace=0.0).collect()
    assert sorted(r["db_id"] for r in got if r["http_status"] == 404) == [0, 3, 6] and all(r["html"] == f"<p>{r['db_id']}</p>" for r in got if r["http_status"] == 200)


def test_runs(spark):
    runs = dml.run_started(spark.createDataFrame([], dml.RUNS), "delta", 300, 50, 40, NOW)
    runs = dml.run_started(dml.run_finished(runs, 1, "completed", "later"), "delta", 300, 90, 80, NOW)
    assert [(r["run_id"], r["status"], r["finished_at"]) for r in runs.orderBy("run_id").collect()] == [(1, "completed", "later"), (2, "running", None)]
    assert dml.resumable(runs).first()["run_id"] == 2 and dml.resumable(dml.run_finished(runs, 2, "completed", NOW)).count() == 0
    pairs = spark.createDataFrame([("last_id", "50")], tables.PAIRS)
    for state, mark in (("queued", "50"), ("written", "90")):
        items = spark.createDataFrame([(2, 60, "new", state), (2, 3, "refresh", "queued")], "run_id long, db_id long, pass string, state string")
        assert dml.advanced(pairs, items, runs, 2).first()["value"] == mark


def test_sinks(spark, sf_dir, tmp_path):
    from quarry.operators import index

    corpus = views.corpus(spark, sf_dir)
    n = corpus.count()
    sinks.write_corpus(corpus, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    sinks.write_corpus(corpus, str(tmp_path / "c"))
    sinks.write_json(corpus, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == n
    sinks.write_freshness(corpus, str(tmp_path / "f"))
    assert tables.pairs(spark, str(tmp_path / "f")).count() == 3
    found = index.build(corpus)
    sinks.write_index(found, str(tmp_path / "i"))
    assert index.fts_match(sinks.read_index(spark, str(tmp_path / "i")), "thing").count() == index.fts_match(found, "thing").count()
    sinks.write_statements(corpus.filter(F.length("resolution") < 50_000).select("*").limit(20), "inquiry", str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).count() >= 1

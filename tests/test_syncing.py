"""The sync driver, its command, the store, health, the shared cache, the stdio server, and reports."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from quarry import stdio, sync as command
from quarry.operators import dml, reports, serve, sync
from quarry.plans import syncing
from quarry.plans.engine import Engine, SharedCache, documents
from quarry.sources import fetch, html, sinks, tables, views
from quarry.sources.store import Store

NOW = "2026-05-07T12:00:00.000Z"
ENTRY = "pos long, db_id string, database string, inquiry_type string, vehicle_data string, status string, submission_date string, resolution_date string"


def page(number, resolution="Use 2.5 hours.", issue="A dent in the door."):
    return f'<form><table class="widefat"><tbody><tr><td>2026-01-01 09:30:00</td><td>Resolved</td></tr></tbody></table><table class="widefat striped"><tbody><tr><td>2019</td><td>Ford</td><td>F150</td><td>SUV</td></tr></tbody></table><table class="widefat"><tbody><tr><td>Inquiry type</td><td>Body Operations</td></tr><tr><td>Issue Summary</td><td>{issue} {number}</td></tr><tr><td>Resolution</td><td>{resolution}</td></tr></tbody></table></form>'


def entries(spark, ids, status="Submitted to IP"):
    return spark.createDataFrame([(i, str(n), "CCC", "Body Operations", "2019 Land Rover Sport", status, "2026-01-01", "") for i, n in enumerate(ids)], ENTRY)


def Site(pages):  # noqa: N802
    """A getter of pages by id; a number is a status, nothing is a 404. A closure, so that it travels to the workers."""

    def get(url):
        got = pages.get(int(url.rstrip("/").rpartition("/")[2]), 404)
        return fetch.Answer(got, url) if isinstance(got, int) else fetch.Answer(200, url, got)

    return get


def fast(**more):
    return syncing.Options(window=3, fetching={"pace": 0.0, "retries": 0}, **more)


@pytest.fixture
def made(spark, tmp_path):
    return syncing.Sync(Store(spark, str(tmp_path / "store"), create=True), lambda: NOW)


def test_a_store_is_not_begun_by_chance(spark, tmp_path):
    with pytest.raises(tables.MissingTable):
        Store(spark, str(tmp_path / "nothing"))
    store = Store(spark, str(tmp_path / "s"), create=True, keep=2)
    for k in range(4):
        store.write("t", spark.range(k + 1))
    assert store.versions("t") == [3, 4] and store.read("t", "id long").count() == 4 and store.read("u", "id long").count() == 0


def test_sync_from_plan_to_high_water(spark, made):
    ids = [1, 2, 3, 5, 8]
    site = Site({n: page(n) for n in ids})
    dry = made.run(site, entries(spark, ids), fast(dry_run=True))
    assert dry.code == syncing.DONE and dry.run_id is None and made.store.versions("raw") == [] and made.runs.count() == 0
    assert {r["cohort"]: r["n"] for r in dry.plan}["new"] == 5
    one = made.run(site, entries(spark, ids), fast(batch=3))
    assert (one.code, one.run_id, one.remaining, one.batch["written"]) == (syncing.DONE, 1, 2, 3)
    assert reports.high_water(made.held, made.pairs).first()["provenance"] == "derived"
    refused = made.run(site, entries(spark, ids), fast())
    assert refused.code == syncing.REFUSED and refused.remaining == 2
    rest = made.run(site, None, fast(resume=True))
    assert (rest.code, rest.remaining, rest.totals["written"]) == (syncing.DONE, 0, 5)
    assert reports.high_water(made.held, made.pairs).first().asDict() == {"high_water": 8, "provenance": "stored"}
    assert made.runs.first()["status"] == "completed" and made.held.filter("body_fetched_at is not null and make = 'Land Rover'").count() == 5
    assert made.run(site, None, fast(resume=True)).code == syncing.REFUSED
    assert any("minutes" in x for x in syncing.lines(dry, fast()))


def test_refresh_delisting_strikes_and_gaps(spark, made):
    pages = {n: page(n) for n in range(1, 21)}
    made.run(Site(pages), entries(spark, range(1, 21)), fast())
    pages |= {20: page(20, "Use 3 hours."), 19: 404}
    two = made.run(Site(pages), entries(spark, [n for n in range(1, 21) if n != 4]), fast())
    assert two.code == syncing.DONE and two.remaining == 0 and two.batch["skipped"] == 1 and two.batch["written"] == 1
    rows = {r["db_id"]: r for r in made.held.collect()}
    assert rows[4]["delisted_at"] == NOW and rows[19]["dead_suspected_at"] == NOW and rows[19]["dead_at"] is None and rows[20]["resolution"] == "Use 3 hours."
    assert [(r["field"], r["n"]) for r in reports.change_histogram(made.items.filter("run_id = 2")).collect()] == [("resolution", 1)]
    assert [r["db_id"] for r in reports.skipped(made.items, 2).collect()] == [19]
    three = made.run(Site(pages), entries(spark, range(1, 21)), fast())
    rows = {r["db_id"]: r for r in made.held.collect()}
    assert three.code == syncing.DONE and rows[19]["dead_at"] == NOW and rows[4]["delisted_at"] is None


def test_an_implausible_snapshot_writes_nothing(spark, made):
    made.run(Site({n: page(n) for n in range(1, 21)}), entries(spark, range(1, 21)), fast())
    made.repair_once()  # a repair of its own, not part of what a snapshot does
    before = {t: made.store.versions(t) for t in ("raw", "items", "runs")}
    for dry in (True, False):
        got = made.run(Site({}), entries(spark, [1, 2]), fast(dry_run=dry))
        assert got.code == syncing.IMPLAUSIBLE and "covers 2 of 20" in got.notes[0]
    assert before == {t: made.store.versions(t) for t in ("raw", "items", "runs")}


def test_the_breaker_keeps_the_queue(spark, made):
    ids = list(range(1, 26))
    got = made.run(Site(dict.fromkeys(ids, 503)), entries(spark, ids), fast())
    assert got.code == syncing.STOPPED and got.batch["fetched"] == syncing.BREAKER and got.remaining == 25
    assert made.runs.first()["status"] == "interrupted" and made.pairs.filter("key = 'last_id'").count() == 0
    back = made.run(Site({n: page(n) for n in ids}), None, fast(resume=True))
    assert back.code == syncing.DONE and back.remaining == 0 and back.totals["written"] == 25


def test_a_forced_run_abandons_the_open_one(spark, made):
    site = Site({n: page(n) for n in (1, 2, 3)})
    made.run(site, entries(spark, [1, 2, 3]), fast(batch=1))
    got = made.run(site, entries(spark, [1, 2, 3]), fast(force_new=True))
    assert got.run_id == 2 and got.code == syncing.DONE
    assert {r["run_id"]: r["status"] for r in made.runs.collect()} == {1: "abandoned", 2: "completed"}


def test_the_command(spark, tmp_path, capsys):
    snapshot = tmp_path / "s.json"
    snapshot.write_text(json.dumps({"count": 2, "data": [{"db_id": str(n), "database": "CCC", "InquiryType": "Frame", "VehicleData": "2019 Ford F150", "status": "Resolved", "SubmissionDate": "2026-01-01", "ResolutionDate": "2026-01-02"} for n in (1, 2)]}))
    call = lambda *more: command.main(["--store", str(tmp_path / "store"), *more], Site({1: page(1), 2: page(2)}))
    assert call() == syncing.REFUSED and call("--snapshot", str(snapshot)) == syncing.REFUSED
    assert call("--snapshot", str(snapshot), "--create", "--batch-size", "0") == syncing.REFUSED
    assert call("--snapshot", str(snapshot), "--create", "--batch-size", "1") == syncing.DONE
    assert "still queued" in capsys.readouterr().out
    assert call("--resume") == syncing.DONE and Store(spark, str(tmp_path / "store")).read("raw", tables.RAW).count() == 2


def test_one_stream_keeps_the_pace(spark):
    got = fetch.fetched(spark.range(40).withColumnRenamed("id", "db_id").repartition(8), Site(dict.fromkeys(range(40), 500)), pace=0.0, retries=0, give_up=10).collect()
    assert len(got) == 10


def test_long_ids_and_many_sections(spark):
    from quarry.functions import record

    rows = spark.createDataFrame([("1234567890123456789x",), ("99999999999999999999",), ("12x",), ("-3",)], "x string")
    assert [r[0] for r in rows.select(record.lenient_int(F.col("x"))).collect()] == [1234567890123456789, 999999999999999999, 12, -3]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_breaker_over_blocks(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(sync, "BLOCK", block)
    rng = random.Random(block)
    rows = [(r, s, 1, rng.choice([200, 503, 503, 429, 404, None]), None) for r in range(6) for s in range(rng.randint(1, 40))]
    want = {}
    for run in range(6):
        streak, longest, stop = 0, 0, None
        for _, s, _, status, _ in [x for x in rows if x[0] == run]:
            streak = streak + 1 if status in (503, 429) else 0
            longest = max(longest, streak)
            if streak >= 3 and stop is None:
                stop = s
        want[run] = (stop, longest)
    got = sync.breaker(spark.createDataFrame(rows, "run_id long, seq long, db_id long, http_status int, reason string"), 3).collect()
    assert {r["run_id"]: (r["stopped_at"], r["longest"]) for r in got} == want


def test_rows_that_fail_the_served_schema_are_set_apart(spark, sf_dir):
    served = serve.served(views.raw(spark, sf_dir))
    good, bad = serve.checked(served)
    assert bad.count() == 0 and good.columns == served.columns and good.count() == served.count()
    odd = served.withColumn("url", F.when(F.col("db_id") % 5 == 0, "u").when(F.col("db_id") % 5 == 1, "https://").when(F.col("db_id") % 5 == 2, "mailto:x").otherwise(F.col("url"))).withColumn("status", F.when(F.col("db_id") % 7 == 0, "odd").otherwise(F.col("status")))
    good, bad = serve.checked(odd)
    issues = {r["db_id"]: r["issue"] for r in bad.collect()}
    assert set(issues) == {r["db_id"] for r in odd.select("db_id").collect() if r["db_id"] % 5 in (0, 1) or r["db_id"] % 7 == 0}
    assert any(x == "url is no address; status is not listed" for x in issues.values()) and good.count() + len(issues) == served.count()


def test_lanes_of_ids_are_packed_alone(spark):
    rows = spark.range(95).select(F.col("id").alias("db_id"), F.concat(F.lit("it's "), F.col("id").cast("string")).alias("title"))
    got = serve.insert_statements(rows, "t", 1, target=200, span=20).orderBy("lane", "number").collect()
    assert {r["lane"] for r in got} == {0, 1, 2, 3, 4} and all(len(r["statement"]) <= 200 for r in got)
    text = "".join(r["statement"] for r in got)
    assert [int(x) for x in __import__("re").findall(r"\((\d+), 'it''s", text)] == list(range(95))
    for lane in range(5):
        assert [r["number"] for r in got if r["lane"] == lane] == list(range(sum(r["lane"] == lane for r in got)))


def test_one_json_array(spark, sf_dir, tmp_path):
    corpus = views.corpus(spark, sf_dir)
    sinks.write_json_array(corpus, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    sinks.write_json_array(corpus, str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    read = json.loads(file.read_text())
    assert [r["db_id"] for r in read] == sorted(r["db_id"] for r in corpus.select("db_id").collect())
    again = tables.corpus_file(spark, str(file))
    assert again.count() == len(read) and again.exceptAll(corpus).count() == 0
    sinks.write_json_array(corpus.limit(0), str(tmp_path / "none"))
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == []


def test_health_says_what_is_wrong(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)
    known = Engine(corpus).freshness()
    good = Engine(corpus, version=known.synced_at).health()
    assert good["ok"] and good["corpus_version_stale"] is False and good["corpus_current_through"] == known.current_through and good["server"] and good["version"]
    assert Engine(corpus, version="old").health()["corpus_version_stale"] is True
    none = Engine(corpus.limit(0), version="x").health()
    assert none["ok"] is False and none["records"] == 0 and none["corpus_version_stale"] is None
    broken = Engine(corpus.withColumn("db_id", F.raise_error(F.lit("gone")).cast("long")).filter("db_id > 0")).health()
    assert broken["ok"] is False and "gone" in broken["error"]


def test_connector_metadata(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)
    row = documents(corpus).first()
    assert len(row["metadata"].asDict()) == 11
    told = Engine(corpus).fetch_document(row["id"])
    assert told["metadata"]["citation"] == row["metadata"]["citation"] and told["metadata"]["submitted_at"].endswith("Z") and told["metadata"]["found"]


def test_an_engine_takes_a_source(spark, sf_dir):
    class Own:
        def corpus(self):
            return views.corpus(spark, sf_dir).filter("db_id < 10")

    assert Engine(Own()).health()["records"] == 10


def test_shared_cache(spark, sf_dir, tmp_path):
    now, made = [0.0], []
    cache = lambda space="v1", folder=str(tmp_path): SharedCache(spark, folder, space, 10, lambda: now[0])
    ask = lambda c: c.get("k", lambda: made.append(1) or {"n": len(made)})
    assert ask(cache()) == ask(cache()) == {"n": 1} and ask(cache("v2")) == {"n": 2}
    now[0] = 11
    assert ask(cache()) == {"n": 3}
    for file in tmp_path.rglob("*.json"):
        file.write_text("no json")
    assert ask(cache()) == {"n": 4}
    assert ask(cache(folder="nosuchscheme://x/y")) == {"n": 5}  # a folder that can't be used costs nothing but the work
    corpus = views.corpus(spark, sf_dir)
    one, two = (Engine(corpus, version="1", cache=SharedCache(spark, str(tmp_path / "e"), "1")) for _ in range(2))
    assert one.search("thing", 3) == two.search("thing", 3) and one.freshness() == two.freshness() and one.get("7") == two.get("7")


def test_stdio_server(spark, sf_dir):
    engine = Engine(views.corpus(spark, sf_dir), version="1")
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "thing", "limit": 2}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get", "arguments": {"id": "7"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "find_supporting", "arguments": {"query": "thing", "now": NOW, "limit": 1}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "list_recent", "arguments": {"since": "no date"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "get", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 8, "method": "odd"},
    ]
    out = io.StringIO()
    stdio.serve(engine, [json.dumps(m) for m in asked] + ["", "no json", "[]"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    by_id = {r["id"]: r for r in got if r["id"]}
    assert len(got) == 10 and by_id[1]["result"]["serverInfo"]["name"] == "quarry"
    assert [t["name"] for t in by_id[2]["result"]["tools"]] == ["search", "get", "list_recent", "find_supporting"] and "2026" in by_id[2]["result"]["tools"][0]["description"]
    assert by_id[3]["result"]["structuredContent"]["count"] == 2 and by_id[4]["result"]["structuredContent"]["found"]
    assert len(by_id[5]["result"]["structuredContent"]["results"]) == 1 and by_id[6]["result"]["isError"]
    assert by_id[7]["error"]["code"] == stdio.BAD_PARAMS and by_id[8]["error"]["code"] == stdio.NO_METHOD


def test_release_dates_of_pages(spark):
    rows = [(1, page(1, "Estimated Release Date: 3/9/2026 or so")), (2, page(2, "none given"))]
    got = {r["db_id"]: r["resolved_at"] for r in html.records(spark.createDataFrame(rows, "db_id long, html string")).collect()}
    assert str(got[1])[:10] == "2026-03-09" and got[2] is None


def test_makes_are_repaired_once(spark, made):
    made.store.write("raw", spark.createDataFrame([(1, "Land", "Rover Sport")], "db_id long, make string, model string").select(*[F.col(c) if c in ("db_id", "make", "model") else F.lit(None).cast(tables.RAW[c].dataType).alias(c) for c in dml.RAW]))
    made.repair_once()
    assert made.held.first()["make"] == "Land Rover"
    n = made.store.versions("raw")
    made.repair_once()
    assert made.store.versions("raw") == n


def test_rows_are_read_back_whatever_they_hold(spark):
    rows = spark.createDataFrame(
        [(1, "CCC", "odd", None, "2026-05-07T12:00:00.250Z", None, "2026-05-07T12:00:00Z", '{"a":"b"}'), (2, "x", "closed", "paint", "no date", "", None, "{broken")],
        "db_id long, ip string, status string, labor_type string, submitted_at string, resolved_at string, last_updated string, metadata string",
    )
    a, b = serve.from_rows(rows).orderBy("db_id").collect()
    assert a["ip"] == "CCC" and a["status"] == "pending" and a["submitted_at"].microsecond == 250_000 and a["last_updated"].second == 0 and a["metadata"] == {"a": "b"}
    assert b["ip"] is None and b["status"] == "closed" and b["submitted_at"] is None and b["resolved_at"] is None and b["metadata"] in ({}, {"a": None})


def test_scraping_parts_the_served_from_the_rest(spark):
    from quarry.sources import scrape

    good, bad = scrape.inquiries(spark.range(1, 4).withColumnRenamed("id", "db_id"), Site({1: page(1), 3: page(3)}), pace=0.0, retries=0)
    assert sorted(r["db_id"] for r in good.collect()) == [1, 3] and [(r["db_id"], r["http_status"]) for r in bad.collect()] == [(2, 404)]

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators import index, search, support
from quarry.plans.engine import Cache, Engine, encoded, rounded
from quarry.sources import tables, views
from quarry.sources.views import NOW

C = F.col
PANEL = [
    "thble ertion attion", "thing", "erble ering", "atti", "ertion the thing", "thtion hable", "onre tion", "eraner blend", "andre ering thst", "ha",
    "thing thing", "reoron", "enden tionth", "thble", "the thtion of attion", "entionth er", "ering attion erble thing", "r&i thing", "stth onth", "ingre",
]


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return views.corpus(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def found(corpus):
    made = index.build(corpus)
    return index.Index(made.postings.persist(), made.lengths.persist())


@pytest.fixture(scope="module")
def phrases(corpus):
    made = index.build_phrases(corpus)
    return index.PhraseIndex(made.words.persist(), made.pairs.persist())


def record(spark, **values):
    row = {f.name: None for f in tables.SERVED.fields} | {"db_id": 1, "id": "1", "inquiry_number": "1", "title": "t", "url": "u", "status": "pending", "metadata": "{}"} | values
    fields = [f"{f.name} {'string' if f.name in ('submitted_at', 'resolved_at', 'last_updated') else f.dataType.simpleString()}" for f in tables.SERVED.fields]
    df = spark.createDataFrame([tuple(row[f.name] for f in tables.SERVED.fields)], ", ".join(fields))
    return df.withColumns({c: C(c).cast("timestamp") for c in ("submitted_at", "resolved_at", "last_updated")})


def score(spark, ask, **values):
    return support.scored(record(spark, submitted_at="2026-05-01T00:00:00Z", **values), ask).first()


def test_parts_of_the_score(spark):
    row = score(spark, support.Ask("blend two", NOW, 2020, "toy", "cor"), issue_summary="Blend-two tone", inquiry_type="Blend work", vehicle_year=2020, vehicle_make="Toyota", vehicle_model="Corolla")
    assert (row["bigram"], row["unigram"], row["text"], row["vehicle"], row["operation"], row["recency"], row["score"]) == (1.0, 1.0, 1.0, 0.3, 0.1, 0.05, 1.0)
    row = score(spark, support.Ask("mitchell two", NOW), issue_summary="two", ip="Mitchell")
    assert row["ip"] == 0.15 and row["unigram"] == 0.5 and row["bigram"] == 0.0


@pytest.mark.parametrize(("now", "boost"), [("2028-04-20T00:00:00Z", 0.05), ("2028-04-20T00:00:00.001Z", 0.0), ("2026-04-30T00:00:00Z", 0.0), ("2026-05-01T00:00:00Z", 0.05)])
def test_recency_is_720_days_inclusive_and_never_ahead(spark, now, boost):
    assert score(spark, support.Ask("x", now), issue_summary="a")["recency"] == boost


def test_bigrams_cross_fields_and_match_inside_words(spark):
    assert score(spark, support.Ask("blend two", NOW), issue_summary="they blend", suggested_action="twofold")["bigram"] == 1.0


def test_scan_keeps_rows_without_a_hit_and_search_drops_them(corpus):
    n = corpus.count()
    assert support.find_supporting(corpus, support.Ask("zzzzqq", NOW), n + 5).count() == n
    assert search.search(corpus, "zzzzqq").count() == 0


def test_stop_words_differ_between_scan_and_index(corpus, found):
    assert search.search(corpus, "the of and", limit=3).count() == 3
    assert index.bm25(found, "the of and").count() == 0
    assert support.find_supporting_indexed(corpus, found, support.Ask("the of and", NOW)).count() == 0


@pytest.mark.parametrize("query", PANEL)
def test_indexed_answer_equals_the_scan_of_what_matches(corpus, found, query):
    """The index finds words by their beginning, the scan inside words too; on records that the index finds both agree."""
    ask = support.Ask(query, NOW)
    matching = corpus.join(index.fts_match(found, query), "db_id", "left_semi")
    a = support.find_supporting(matching, ask, 5).select("id", "score", *support.PARTS).collect()
    b = support.find_supporting_indexed(corpus, found, ask, 5).select("id", "score", *support.PARTS).collect()
    assert a == b


@pytest.mark.parametrize("query", [*PANEL, "the of and"])
def test_phrase_index_gives_the_scan_itself(corpus, phrases, query):
    for ask in (support.Ask(query, NOW), support.Ask(query, "2016-01-01T00:00:00Z", 2011, "rover", "sport")):
        a = support.find_supporting(corpus, ask, 5).select("id", "score", *support.PARTS, "snippet").collect()
        assert a == support.find_supporting_exact(corpus, phrases, ask, 5).select("id", "score", *support.PARTS, "snippet").collect()


def test_bm25_equals_sqlite(corpus, found):
    con = sqlite3.connect(":memory:")
    names = list(index.WEIGHTS)
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(names)})")
    rows = corpus.select("db_id", *names).collect()
    con.executemany(f"INSERT INTO f(rowid, {', '.join(names)}) VALUES ({', '.join('?' * (len(names) + 1))})", [tuple(r) for r in rows])
    weights = ", ".join(str(w) for w in index.WEIGHTS.values())
    for query in ["thble ertion attion", "thing", "atti", "ha ha", "enten etre"]:
        match = " OR ".join(f'"{t}"' + "*" * p for _, t, p in index.phrases(query))
        want = dict(con.execute(f"SELECT rowid, bm25(f, {weights}) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r["db_id"]: r["rank"] for r in index.bm25(found, query).collect()}
        assert got.keys() == want.keys() and got
        assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_index_follows_changes(spark, corpus, found):
    new = corpus.filter("db_id < 150").withColumn("title", F.when(C("db_id") == 3, "zebra crossing").otherwise(C("title")))
    changed = spark.range(150, 200).withColumnRenamed("id", "db_id").unionByName(spark.createDataFrame([(3,)], "db_id long"))
    after, want = index.updated(found, new, changed), index.build(new)
    assert after.postings.exceptAll(want.postings).count() == 0 and want.postings.exceptAll(after.postings).count() == 0
    assert index.fts_match(after, "zebra").collect() == [(3,)]


def test_filters(spark, corpus):
    assert search.parsed_filters({"vehicle_year": "2011", "ip": "nobody", "status": "open", "x": 1, "vehicle_make": "F"}) == {"vehicle_make": "F"}
    assert corpus.filter(search.predicate({"vehicle_make": "%"})).count() == 0
    assert corpus.filter(search.predicate({"vehicle_make": ""})).count() == corpus.count()
    assert corpus.filter(search.predicate({"ip": "unknown"})).count() == corpus.filter("ip is null").count() > 0
    assert record(spark, vehicle_year=0).filter(search.predicate({"vehicle_year": 0})).count() == 1


def test_ids(corpus):
    assert search.get_by_id(corpus, "7").count() == search.get_by_id(corpus, 7).count() == 1
    assert search.get_by_id(corpus, "0007").count() == 1
    for odd in ("7x", "", " 7", "-7", "9" * 40):
        assert search.get_by_id(corpus, odd).count() == 0


def test_paging(corpus):
    whole = [r["id"] for r in search.search(corpus, limit=30).collect()]
    assert whole == [r["id"] for k in (0, 10, 20) for r in search.search(corpus, limit=10, offset=k).collect()]
    assert search.search(corpus, limit=5, offset=10**6).count() == 0 and search.search(corpus, limit=0).count() == 0


def test_engine_answers(corpus):
    engine = Engine(corpus, version="1")
    hits = engine.search("thing", limit=3)
    assert hits["count"] == 3 and hits["corpus_current_through"] and "corpus_note" not in hits
    assert "corpus_note" in engine.search("recent thing", limit=1)
    assert engine.get("7")["found"] and not engine.get("7x")["found"]
    assert "ends" in engine.list_recent("2090-01-01T00:00:00Z")["corpus_note"]
    one = engine.find_supporting(support.Ask("thing", NOW), limit=2)
    assert len(one["results"]) == 2 and set(one["results"][0]["breakdown"]) == {*support.PARTS, "total"}
    assert engine.find_supporting(support.Ask("of the", NOW), indexed=True)["results"] == []
    assert engine.fetch_document("7")["metadata"]["found"] and not engine.fetch_document("x")["metadata"]["found"]
    assert len(engine.find_documents("thing")["results"]) == 10
    assert engine.describe("A tool.").startswith("A tool.\n\n") and engine.health()["records"] == corpus.count()
    assert "results" in encoded(hits)["structured"]


def test_rounding_is_of_the_binary_value():
    assert [rounded(x) for x in (1.0005, 0.0625, 0.1235, 2 / 3)] == [1.0, 0.063, 0.123, 0.667]


def test_results_are_kept_for_a_while():
    now, made = [0.0], []
    cache = Cache(seconds=10, most=2, clock=lambda: now[0])
    ask = lambda k: cache.get(k, lambda: made.append(k) or len(made))
    assert ask("a") == ask("a") == 1
    now[0] = 11
    assert ask("a") == 2
    ask("b"), ask("c")
    assert list(cache.held) == ["b", "c"]

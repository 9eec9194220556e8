"""The registered queries of the record engine: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import freshness, record, text
from quarry.operators import dml, index, reports, search, serve, support, sync
from quarry.plans.engine import documents
from quarry.sources import html, scrape, tables, views
from quarry.sources.views import NOW, TODAY
from quarry.streaming import ingest

C = F.col
QUERY = "thble ertion attion"
ONE_WORD = "thing"
MIXED = "r&i thing, the atti"
WINDOW = 300
#: Ids of a lane of load statements, and the run that queue queries look at.
LANE_IDS, RUN = 500, 19723
STAMP = "2026-05-07T12:00:00.000Z"
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _live(s: SparkSession, d: str) -> DataFrame:
    return sync.deduplicated(views.feed(s, d))


@query
def text_normalize(s, d):
    return views.table(s, d, "documents").select("doc_id", text.normalise(C("text")).alias("normalised"))


@query
def text_tokenize(s, d):
    t = text.tokens(C("text"))
    return views.table(s, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def text_bigrams(s, d):
    return views.table(s, d, "documents").select("doc_id", text.bigrams(text.tokens(C("text"))).alias("b")).select("doc_id", F.size("b").alias("n_bigrams"), F.array_join("b", "|").alias("bigrams"))


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("id", "score", record.iso(C("submitted_at")).alias("submitted_at"), "snippet")


@query
def search_coverage(s, d):
    return _hits(search.search(views.corpus(s, d), "Thing ertion, the thble", limit=50))


@query
def search_browse(s, d):
    return _hits(search.search(views.corpus(s, d), limit=50))


@query
def search_filtered(s, d):
    filters = {"vehicle_make": "rover", "ip": "unknown", "status": "resolved", "inquiry_type": "operations", "nonsense": 1, "vehicle_year": "2011"}
    return _hits(search.search(views.corpus(s, d), "the", filters, limit=50))


@query
def search_paged(s, d):
    return _hits(search.search(views.corpus(s, d), ONE_WORD, limit=20, offset=20))


@query
def search_indexed(s, d):
    corpus = views.corpus(s, d)
    rows = index.search_indexed(corpus, index.build(corpus), QUERY, {"status": "resolved"}, limit=20)
    return rows.select("id", "score", F.round("rank", 9).alias("rank"))


@query
def get_by_id(s, d):
    return search.get_by_id(views.corpus(s, d), "42").select("db_id", "id", "title", "issue_summary", "resolution", record.iso(C("last_updated")).alias("last_updated"))


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "title", record.iso(C("submitted_at")).alias("submitted_at"))


@query
def list_recent(s, d):
    return _listed(search.list_recent(views.corpus(s, d), limit=25))


@query
def list_recent_since(s, d):
    return _listed(search.list_recent(views.corpus(s, d), "2016-01-01T00:00:00Z", limit=1000))


def _supported(rows: DataFrame) -> DataFrame:
    return rows.select("id", *support.PARTS, "score", "snippet")


@query
def find_supporting_scan(s, d):
    return _supported(support.find_supporting(views.corpus(s, d), support.Ask(QUERY, NOW), 20))


@query
def find_supporting_all_scores(s, d):
    return support.scored(views.corpus(s, d), support.Ask(MIXED, "2019-05-07T12:00:00Z", 2010, "ROVER", "range")).select("id", *support.PARTS, "score")


@query
def find_supporting_vehicle(s, d):
    return _supported(support.find_supporting(views.corpus(s, d), support.Ask(ONE_WORD, NOW, 2011, "rover", "Sport"), 20))


@query
def find_supporting_ip(s, d):
    return _supported(support.find_supporting(views.corpus(s, d), support.Ask("mitchell refinish thing erble", "2020-05-07T12:00:00Z"), 20))


@query
def fts_match(s, d):
    return index.fts_match(index.build(views.corpus(s, d)), MIXED)


@query
def bm25_rank(s, d):
    return index.bm25(index.build(views.corpus(s, d)), QUERY).select("db_id", F.round("rank", 9).alias("rank"))


@query
def postings(s, d):
    return index.build(views.corpus(s, d)).postings


@query
def candidate_pool(s, d):
    corpus = views.corpus(s, d)
    return support.pool(corpus, index.build(corpus), QUERY)


@query
def find_supporting_two_arm(s, d):
    corpus = views.corpus(s, d)
    return _supported(support.find_supporting_indexed(corpus, index.build(corpus), support.Ask(QUERY, NOW), 20))


@query
def find_supporting_exact(s, d):
    corpus = views.corpus(s, d)
    return _supported(support.find_supporting_exact(corpus, index.build_phrases(corpus), support.Ask(QUERY, NOW), 20))


@query
def phrase_hits(s, d):
    return index.phrase_hits(index.build_phrases(views.corpus(s, d)), MIXED)


@query
def snippet_literal(s, d):
    return views.corpus(s, d).select("id", text.snippet_literal("The thing").alias("snippet"))


@query
def snippet_token(s, d):
    return views.corpus(s, d).select("id", text.snippet_token("the attion erble").alias("snippet"))


@query
def citation(s, d):
    c = record.citation()
    return views.corpus(s, d).select("id", c["short_form"].alias("short_form"), c["long_form"].alias("long_form"))


@query
def document_flatten(s, d):
    return views.corpus(s, d).select("id", record.flattened().alias("document"))


@query
def corpus_freshness(s, d):
    return freshness.summary(views.corpus(s, d))


@query
def freshness_pairs(s, d):
    return freshness.as_pairs(freshness.summary(views.corpus(s, d)))


@query
def recency_intent(s, d):
    rows = views.table(s, d, "conversations")
    return rows.select("conv_id", "turn", freshness.recency_asked(C("text"), F.lit(2024)).alias("asked"))


@query
def dedup_last_wins(s, d):
    return _live(s, d).select("db_id", "pos", "status", "resolution_date", "vehicle_data")


@query
def cohort_new(s, d):
    return sync.new_ids(_live(s, d), views.raw(s, d))


@query
def cohort_changed(s, d):
    return sync.changed_ids(_live(s, d), views.raw(s, d))


@query
def cohort_delisted(s, d):
    return sync.delisted_ids(_live(s, d), views.raw(s, d))


@query
def cohort_reappeared(s, d):
    return sync.reappeared_ids(_live(s, d), views.raw(s, d))


@query
def unresolved_cohort(s, d):
    return sync.unresolved_ids(views.raw(s, d))


@query
def resolved_blank_cohort(s, d):
    return sync.blank_resolved_ids(views.raw(s, d), "2016-06-01")


@query
def suspected_cohort(s, d):
    return sync.suspected_ids(views.raw(s, d))


@query
def trailing_window(s, d):
    return sync.trailing_ids(views.raw(s, d), WINDOW)


@query
def sync_queue(s, d):
    return sync.queue(_live(s, d), views.raw(s, d), TODAY, WINDOW)


@query
def plan_sanity(s, d):
    return sync.plan_sanity(_live(s, d), views.raw(s, d))


@query
def gaps_below_high_water(s, d):
    held = views.raw(s, d)
    return sync.gap_ids(_live(s, d), held, reports.high_water(held))


@query
def queued_items(s, d):
    return reports.queued(views.queue_items(s, d))


@query
def find_baseline(s, d):
    return search.find_baseline(views.corpus(s, d), "thing the", 2011, "rover", "sport", 20).select("id", "confidence", "snippet")


@query
def queue_estimate(s, d):
    return reports.estimate(sync.queue(_live(s, d), views.raw(s, d), TODAY, WINDOW))


@query
def upsert_metadata(s, d):
    out = dml.upserted(views.raw(s, d), dml.metadata_rows(_live(s, d), STAMP))
    return out.select("db_id", "database", "status", "resolution_status", "year", "make", "model", "resolution_date", "source_url", "body_fetched_at", "last_seen_at", "issue_summary")


@query
def delist_stamp(s, d):
    live, held = _live(s, d), views.raw(s, d)
    return dml.stamped_delisted(held, sync.delisted_ids(live, held), sync.reappeared_ids(live, held), STAMP).select("db_id", "delisted_at")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return html.details(views.detail_pages(s, d))


@query
def html_detail_parse(s, d):
    return _pages(s, d).drop("tracking")


@query
def html_detail_record(s, d):
    rows = html.records(views.detail_pages(s, d))
    return rows.select("db_id", "title", "ip", "labor_type", "status", record.iso(C("submitted_at")).alias("submitted_at"), record.iso(C("last_updated")).alias("last_updated"))


@query
def backfill_merge(s, d):
    return dml.backfilled(views.raw(s, d), _pages(s, d), STAMP).select("db_id", "inquiry_type", "make", "model", "issue_summary", "resolution", "resolution_status", "submitted_datetime", "body_fetched_at")


@query
def refresh_merge(s, d):
    out = dml.refreshed(views.raw(s, d), _pages(s, d), STAMP)
    return out.select("db_id", "outcome", "changed_fields", "inquiry_type", "make", "model", "issue_summary", "suggested_action", "resolution", "content_hash", "body_fetched_at")


@query
def repair_makes(s, d):
    return dml.repaired_makes(views.raw(s, d)).select("db_id", "make", "model", "repaired")


@query
def repaired_by_make(s, d):
    return dml.repaired_makes(views.raw(s, d)).filter("repaired is not null").groupBy("repaired").agg(F.count("*").alias("n"))


@query
def content_hash(s, d):
    return views.raw(s, d).select("db_id", record.content_hash().alias("content_hash"))


@query
def field_diff(s, d):
    held = views.raw(s, d)
    now = dml.upserted(held, dml.metadata_rows(_live(s, d), STAMP)).select("db_id", *[C(c).alias(f"n_{c}") for c in record.HASHED_FIELDS])
    changed = record.changed_fields(F.col, lambda c: C(f"n_{c}"))
    return held.join(now, "db_id").select("db_id", F.array_join(changed, ",").alias("changed_fields"))


@query
def change_histogram(s, d):
    return reports.change_histogram(views.queue_items(s, d))


@query
def run_summary(s, d):
    return reports.run_summary(views.queue_items(s, d))


@query
def record_outcomes(s, d):
    items = views.queue_items(s, d)
    state = F.when(sync.transient(C("http_status")), "transient").when(C("http_status") == 200, "unchanged").otherwise("skipped")
    found = views.outcomes(s, d).select("run_id", C("seq").alias("db_id"), state.alias("state"), "http_status", "reason", F.lit(0).alias("changed"), F.lit(None).cast("string").alias("changed_fields"))
    return dml.recorded(items, found, STAMP).select("run_id", "db_id", "state", "attempts", "http_status", "reason", "changed")


@query
def queue_enqueue(s, d):
    out = dml.enqueued(views.queue_items(s, d), 19723, sync.queue(_live(s, d), views.raw(s, d), TODAY, WINDOW), STAMP)
    return out.filter("run_id = 19723").select("run_id", "db_id", "pass", "state", "attempts")


@query
def status_counts(s, d):
    return reports.status_counts(views.raw(s, d))


@query
def non_delisted(s, d):
    return reports.non_delisted(views.raw(s, d))


@query
def pending_bodies(s, d):
    return reports.pending_ids(views.raw(s, d))


@query
def high_water(s, d):
    return reports.high_water(views.raw(s, d))


@query
def freq_by_ip(s, d):
    return reports.frequency(views.corpus(s, d), "ip")


@query
def freq_by_make(s, d):
    return reports.frequency(views.corpus(s, d), "vehicle_make")


@query
def freq_by_type(s, d):
    return reports.frequency(views.corpus(s, d), "inquiry_type")


@query
def corpus_span(s, d):
    return reports.span(views.corpus(s, d)).select("n", record.iso(C("first_at")).alias("first_at"), record.iso(C("last_at")).alias("last_at"))


@query
def corpus_positions(s, d):
    return reports.positions(views.corpus(s, d))


@query
def transform_served(s, d):
    out = serve.to_rows(serve.served(views.raw(s, d)))
    return out.select("db_id", "id", "title", "url", "ip", "inquiry_type", "vehicle_year", "vehicle_make", "issue_summary", "suggested_action", "resolution", "status", "submitted_at", "resolved_at", "last_updated")


@query
def transform_dispositions(s, d):
    return serve.derived(views.raw(s, d)).groupBy("disposition").agg(F.count("*").alias("n"), F.count_if("derived_issue").alias("derived"))


@query
def served_diff(s, d):
    return serve.difference(views.corpus(s, d), serve.served(views.raw(s, d)))


@query
def load_values(s, d):
    return serve.insert_values(serve.to_rows(views.corpus(s, d)).select("db_id", "id", "title", "ip", "vehicle_year", "issue_summary", "submitted_at")).select("db_id", "values")


@query
def load_sizes(s, d):
    return reports.load_sizes(serve.insert_values(serve.to_rows(views.corpus(s, d)).select("db_id", "title", "issue_summary", "suggested_action", "resolution")))


@query
def load_statements(s, d):
    rows = serve.to_rows(views.corpus(s, d))
    return serve.insert_statements(rows, "inquiry", 1, most=1 << 22, span=LANE_IDS).select("lane", "number", F.length("statement").alias("size"))


@query
def vehicle_parse(s, d):
    rows = _live(s, d).select("db_id", "vehicle_data", record.vehicle(C("vehicle_data")).alias("v"))
    return rows.select("db_id", "vehicle_data", "v.year", "v.make", "v.model")


@query
def classify_ip(s, d):
    extra = F.concat_ws(" ", "text", F.get(F.array(F.lit("MOTOR and P-Pages"), F.lit("mitchell dbrm"), F.lit("Qapter, Mitchell"), F.lit("DBRM section; Solera")), F.pmod("doc_id", F.lit(5)).cast("int")))
    return views.table(s, d, "documents").select("doc_id", record.text_provider(extra).alias("ip"))


@query
def section_parse(s, d):
    marked = F.concat(F.lit("Section6_IssueSummary "), "issue_summary", F.lit(" Section6_SuggestedAction "), F.coalesce("suggested_action", F.lit("")), F.lit(" Section3_IssueSummary again Section6_AreaVehicle "), F.coalesce("area_of_vehicle", F.lit("")))
    rows = views.corpus(s, d).select("db_id", record.sections(F.regexp_replace(marked, r"\s+", " ")).alias("x"))
    return rows.select("db_id", "x.issue_summary", "x.suggested_action", "x.area_of_vehicle")


@query
def lenient_ids(s, d):
    odd = F.concat(F.get(F.array(F.lit(""), F.lit("  "), F.lit("+"), F.lit("-"), F.lit("x")), F.pmod("doc_id", F.lit(6)).cast("int")), C("doc_id").cast("string"), F.lit("x"))
    return views.table(s, d, "documents").select("doc_id", record.lenient_int(F.coalesce(odd, F.lit(""))).alias("number"))


@query
def implausible_makes(s, d):
    return views.raw(s, d).select("db_id", record.implausible_make(F.concat_ws(" ", F.when(C("year") < 2008, C("year").cast("string")), F.nullif(C("make"), F.lit("Ford")), F.when(C("year") > 2020, "with a long tail of words"))).alias("implausible"))


@query
def circuit_breaker(s, d):
    return sync.breaker(views.outcomes(s, d), 3)


@query
def dead_two_strike(s, d):
    return sync.two_strikes(views.outcomes(s, d))


@query
def dead_marks(s, d):
    return dml.marked_dead(views.raw(s, d), sync.two_strikes(views.outcomes(s, d)), STAMP).select("db_id", "dead_suspected_at", "dead_at")


@query
def served_readback(s, d):
    odd = views.corpus(s, d).withColumns({"ip": F.coalesce("ip", F.lit("Other")), "status": F.when(C("status") == "pending", "odd").otherwise(C("status")), "labor_type": F.coalesce("labor_type", F.lit("none"))})
    return serve.coerced(odd).select("db_id", "ip", "status", "labor_type")


@query
def corpus_count(s, d):
    return views.corpus(s, d).agg(F.count("*").alias("n"))


@query
def search_payload(s, d):
    hits = search.search(views.corpus(s, d), "Thing ertion, the thble", limit=50)
    return hits.select(search.hit_payload().alias("h")).select("h.*")


@query
def support_payload(s, d):
    hits = support.find_supporting(views.corpus(s, d), support.Ask(ONE_WORD, NOW, 2011, "rover", "Sport"), 20)
    rows = hits.select(support.payload().alias("h")).select("h.id", "h.confidence", "h.breakdown.*", "h.vehicle.*", "h.snippet", "h.citation.short_form")
    return rows.withColumnRenamed("short_form", "citation")


@query
def connector_documents(s, d):
    return documents(views.corpus(s, d)).select("id", "title", "url", "text", "metadata.*")


@query
def cohort_report(s, d):
    return reports.cohorts(_live(s, d), views.raw(s, d), TODAY, WINDOW)


@query
def skipped_items(s, d):
    return reports.skipped(views.queue_items(s, d), RUN)


@query
def first_ids(s, d):
    return reports.first_ids(views.corpus(s, d))


@query
def queue_order(s, d):
    return ingest.drain(views.queue_items(s, d)).select("run_id", "db_id", "pass")


def _pairs(s: SparkSession, d: str, where: str) -> DataFrame:
    """Key/value rows: each source with its greatest document."""
    docs = views.table(s, d, "documents").filter("source is not null").filter(where)
    return docs.groupBy(C("source").alias("key")).agg(F.max("doc_id").cast("string").alias("value"))


@query
def key_value_upsert(s, d):
    return dml.pairs_upserted(_pairs(s, d, "doc_id % 3 = 0"), _pairs(s, d, "lang = 'en'"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    """A row a run of the queue's items: open while an item is queued."""
    items = views.queue_items(s, d)
    left = F.bool_or(C("state") == "queued")
    found = items.groupBy("run_id").agg(F.when(left, "running").otherwise("completed").alias("status"), F.max("db_id").alias("index_max_db_id"), F.count("*").alias("index_count"))
    return found.select("run_id", F.lit(STAMP).alias("started_at"), F.lit(None).cast("string").alias("finished_at"), F.lit("nightly").alias("mode"), F.lit(WINDOW).alias("refresh_window"), "index_max_db_id", "index_count", "status")


@query
def run_lifecycle(s, d):
    runs = dml.run_finished(dml.run_started(_runs(s, d), "catchup", 1000, 90, 80, STAMP), RUN, "interrupted", STAMP)
    return runs.select("run_id", "finished_at", "mode", "refresh_window", "index_max_db_id", "index_count", "status")


@query
def resumable_run(s, d):
    return dml.resumable(_runs(s, d)).select("run_id", "status")


@query
def high_water_advance(s, d):
    """The mark after each of two syncs: one with new items left, and one in which all were taken."""
    items, runs = views.queue_items(s, d), _runs(s, d)
    pairs = s.createDataFrame([("last_id", "5"), ("other", "x")], tables.PAIRS)
    taken = items.withColumn("state", F.when(C("state") == "queued", "written").otherwise(C("state")))
    both = [dml.advanced(pairs, x, runs, RUN).withColumn("drained", F.lit(n)) for x, n in ((items, False), (taken, True))]
    return both[0].unionByName(both[1])


@query
def release_dates(s, d):
    day = F.concat_ws("/", F.pmod("db_id", F.lit(12)) + 1, F.pmod("db_id", F.lit(28)) + 1, F.lit("2025"))
    said = F.when(F.pmod("db_id", F.lit(3)) == 0, "as stated").otherwise(F.concat(F.lit("Approved. estimated release date: "), day, F.lit(", or later")))
    end = "</tbody></table></form>"
    rows = views.detail_pages(s, d).withColumn("html", F.replace("html", F.lit(end), F.concat(F.lit("<tr><td>Resolution</td><td>"), said, F.lit(f"</td></tr>{end}"))))
    return html.records(rows).select("db_id", record.iso(C("resolved_at")).alias("resolved_at"), record.iso(C("last_updated")).alias("last_updated"))


@query
def transform_errors(s, d):
    odd = F.when(F.pmod("db_id", F.lit(7)) == 0, "nowhere").when(F.pmod("db_id", F.lit(7)) == 1, "https:///x").otherwise(C("url"))
    rows = serve.served(views.raw(s, d)).withColumns({"url": odd, "ip": F.when(F.pmod("db_id", F.lit(5)) == 0, "Other").otherwise(C("ip"))})
    return serve.checked(rows)[1]


@query
def row_readback(s, d):
    rows = serve.from_rows(serve.to_rows(views.corpus(s, d)))
    return rows.select("db_id", "ip", "status", record.iso(C("submitted_at")).alias("submitted_at"), record.iso(C("resolved_at")).alias("resolved_at"), C("metadata")["lastSeenAt"].alias("seen"))


@query
def scraped_pages(s, d):
    pages = views.detail_pages(s, d).select("db_id", F.when(F.pmod("db_id", F.lit(5)) == 0, 404).otherwise(200).alias("http_status"), F.when(F.pmod("db_id", F.lit(5)) == 0, "not found").alias("reason"), F.when(F.pmod("db_id", F.lit(5)) != 0, C("html")).alias("html"))
    good, bad = scrape.of_pages(pages)
    return good.select("db_id", "title", F.lit(None).cast("int").alias("http_status")).unionByName(bad.select("db_id", F.lit(None).cast("string").alias("title"), "http_status"))


@query
def load_refusals(s, d):
    bad = F.when(F.pmod("db_id", F.lit(11)) == 0, F.lit("a\u0007b")).when(F.pmod("db_id", F.lit(11)) == 1, "x BEGIN TRANSACTION y").when(F.pmod("db_id", F.lit(11)) == 2, "tab\tand\nline")
    rows = serve.to_rows(views.corpus(s, d)).select("db_id", F.coalesce(bad, C("title")).alias("title"))
    return serve.refusals(rows)


@query
def since_beyond_end(s, d):
    corpus = views.corpus(s, d)
    since = F.when(F.pmod("db_id", F.lit(9)) != 0, record.iso(F.timestamp_millis(F.unix_millis("submitted_at") + 86400000 * 60)))
    known = F.broadcast(freshness.summary(corpus).select("current_through"))
    return corpus.select("db_id", since.alias("since")).join(known).select("db_id", freshness.beyond_end(C("since"), C("current_through")).alias("beyond"))


@query
def postings_updated(s, d):
    """The index brought up to date: a third of the records change their title, a seventh go."""
    corpus = views.corpus(s, d)
    changed = corpus.select("db_id").filter("db_id % 3 = 0 or db_id % 7 = 0")
    after = corpus.filter("db_id % 7 != 0").withColumn("title", F.when(F.pmod("db_id", F.lit(3)) == 0, F.concat(F.lit("Amended "), "title")).otherwise(C("title")))
    return index.updated(index.build(corpus), after, changed).postings

"""One sync from plan to high-water mark, over the versioned tables of a store.

A sync without ``resume`` plans against the tables as they stand, refuses an implausible snapshot
before anything is written, then upserts, stamps, and queues. Every sync drains one batch of the
open run's queue: pages are fetched, parsed, merged, and their outcomes recorded. When the queue
is empty the high-water mark moves, if no new id was left, and the run ends.

Tables are written in an order that lets a sync that died be run again: the crawl table, then
the queue, then the run. A page whose outcome was not recorded is fetched once more and merges to
the same row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dml, reports, sync
from quarry.sources import fetch, html, tables
from quarry.sources.store import Store
from quarry.streaming.ingest import drain

ITEMS = "run_id long, db_id long, pass string, state string, attempts int, http_status int, reason string, changed int, changed_fields string, updated_at string"
#: Exit codes: done, refused by the state of the runs, stopped by the breaker, refused by the snapshot.
DONE, REFUSED, STOPPED, IMPLAUSIBLE = 0, 1, 2, 3
#: Transient failures in a row that stop a batch.
BREAKER = 10
OPEN = ("running", "interrupted")
REPAIRED = "makes_repaired"


@dataclass(frozen=True)
class Options:
    batch: int = 500
    window: int = 1000
    resume: bool = False
    dry_run: bool = False
    force_new: bool = False
    index_only: bool = False
    mode: str = "catchup"
    site: str = fetch.SITE
    fetching: dict = field(default_factory=dict)  # what fetch.fetched takes beyond the queue and the getter

    def __post_init__(self) -> None:
        if self.batch <= 0 or self.window < 0 or self.mode not in ("catchup", "nightly"):
            raise ValueError("batch must be above 0, window not below it, mode catchup or nightly")


@dataclass
class Outcome:
    """How a sync ended, and what it did or would do."""

    code: int
    run_id: int | None = None
    plan: list[dict] = field(default_factory=list)
    batch: dict[str, int] = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    remaining: int = 0
    notes: list[str] = field(default_factory=list)


class Sync:
    def __init__(self, store: Store, now: Callable[[], str]) -> None:
        self.store, self.now = store, now

    @property
    def held(self) -> DataFrame:
        return self.store.read("raw", tables.RAW)

    @property
    def items(self) -> DataFrame:
        return self.store.read("items", ITEMS)

    @property
    def runs(self) -> DataFrame:
        return self.store.read("runs", dml.RUNS)

    @property
    def pairs(self) -> DataFrame:
        return self.store.read("pairs", tables.PAIRS)

    def run(self, get: fetch.Getter, entries: DataFrame | None = None, options: Options = Options()) -> Outcome:  # noqa: B008
        """One sync; ``entries`` are the snapshot's, which a resumed run doesn't need."""
        if not options.dry_run:
            self.repair_once()
        was = dml.resumable(self.runs).first()
        queued = self.queued(was["run_id"]) if was else 0
        if options.resume:
            if was is None:
                return Outcome(REFUSED, notes=["no run is open; a new one has to be planned"])
            result = Outcome(DONE, was["run_id"])
        else:
            if queued and not options.force_new:
                return Outcome(REFUSED, was["run_id"], remaining=queued, notes=[f"run {was['run_id']} is open with {queued} items; resume it or force a new one"])
            result = self.planned(entries, options)
            if result.code != DONE or options.dry_run:
                return result
            result.run_id = self.opened(entries, options, was)
        self.drained(result, get, options)
        return result

    def repair_once(self) -> None:
        """Puts two-word makes together again, once in a store's life."""
        if self.pairs.filter(F.col("key") == REPAIRED).count() == 0 and self.store.versions("raw"):
            self.store.write("raw", dml.repaired_makes(self.held).select(*dml.RAW))
            self.set(REPAIRED, self.now())

    def set(self, key: str, value: str) -> None:
        self.store.write("pairs", dml.pairs_upserted(self.pairs, self.store.spark.createDataFrame([(key, value)], tables.PAIRS)))

    def queued(self, run_id: int) -> int:
        return self.items.filter((F.col("run_id") == run_id) & (F.col("state") == "queued")).count()

    def planned(self, entries: DataFrame, options: Options) -> Outcome:
        """The plan's cohorts, and whether to act on it: the sanity check also speaks on a dry run."""
        live, held = sync.deduplicated(entries), self.held
        result = Outcome(DONE, plan=[r.asDict() for r in reports.cohorts(live, held, self.now()[:10], options.window, options.index_only).collect()])
        sane = sync.plan_sanity(live, held).first()
        if held.limit(1).count() and not sane["ok"]:
            result.code = IMPLAUSIBLE
            result.notes.append(f"the snapshot covers {sane['live']} of {sane['held']} held rows and would delist {sane['delisted']}; nothing was written")
        return result

    def opened(self, entries: DataFrame, options: Options, before) -> int:
        """Applies the snapshot and opens a run with its queue, all from the plan made before the upsert."""
        now, live, held = self.now(), sync.deduplicated(entries), self.held
        queue = self.store.write("queue", sync.queue(live, held, now[:10], options.window, options.index_only))
        gone, back = sync.delisted_ids(live, held), sync.reappeared_ids(live, held)
        top = live.agg(F.max("db_id").alias("max_id"), F.count("*").alias("n")).first()
        runs = self.runs
        if before is not None:
            runs = dml.run_finished(runs, before["run_id"], "abandoned" if options.force_new else "completed", now)
        self.store.write("raw", dml.stamped_delisted(dml.upserted(held, dml.metadata_rows(live, now, options.site)), gone, back, now))
        self.set("last_index_sync", now)
        runs = self.store.write("runs", dml.run_started(runs, options.mode, options.window, top["max_id"], top["n"], now))
        run_id = runs.agg(F.max("run_id")).first()[0]
        self.store.write("items", dml.enqueued(self.items, run_id, queue, now))
        return run_id

    def drained(self, result: Outcome, get: fetch.Getter, options: Options) -> None:
        """Takes one batch off the queue, and closes the run if that was the last."""
        run_id = result.run_id
        mine = self.items.filter(F.col("run_id") == run_id)
        tried = 0
        if self.queued(run_id):
            todo = self.store.write("todo", drain(mine, options.batch).select("run_id", "db_id", "pass").coalesce(1))
            tried = todo.count()
            pages = self.store.write("pages", fetch.fetched(todo, get, give_up=BREAKER, site=options.site, **options.fetching))
            self.merged(result, todo, pages)
        now, result.remaining = self.now(), self.queued(run_id)
        row = reports.run_summary(self.items.filter(F.col("run_id") == run_id)).first()
        result.totals = row.asDict() if row else {}
        if tried and result.batch["fetched"] < tried or result.batch.get("in_row", 0) >= BREAKER:
            result.code = STOPPED
            result.notes.append(f"{BREAKER} transient failures in a row; what was not fetched stays queued")
            self.store.write("runs", dml.run_finished(self.runs, run_id, "interrupted", now))
        elif result.remaining == 0:
            self.store.write("pairs", dml.advanced(self.pairs, self.items, self.runs, run_id))
            self.store.write("runs", dml.run_finished(self.runs, run_id, "completed", now))
        else:
            result.notes.append(f"{result.remaining} items are still queued")

    def merged(self, result: Outcome, todo: DataFrame, pages: DataFrame) -> None:
        """Merges a batch's pages into the crawl table and records their outcomes."""
        now, held = self.now(), self.held
        told = pages.join(todo, "db_id")
        good = (F.col("http_status") == 200) & F.col("html").isNotNull()
        found = html.details(pages.filter(good)).join(todo.select("db_id", "pass"), "db_id")
        first = dml.backfilled(held, found.filter("pass = 'new'"), now)
        again = self.store.write("refreshed", dml.refreshed(held, found.filter("pass = 'refresh'"), now))
        merged = first.join(again.select("db_id"), "db_id", "left_anti").unionByName(again.select(*dml.RAW))
        strikes = sync.two_strikes(told.select("db_id", F.lit(0).alias("seq"), "http_status", "reason"))
        after = told.join(again.select("db_id", "outcome", F.col("changed_fields").alias("fields")), "db_id", "left")
        state = (
            F.when(sync.transient(F.col("http_status")), "transient")
            .when(~good, "skipped")
            .when(F.col("pass") == "new", "written")
            .otherwise(F.col("outcome"))
        )
        reason = F.when(F.col("outcome") == "skipped", "suspect page").otherwise(F.col("reason"))
        outcomes = after.select("run_id", "db_id", state.alias("state"), "http_status", reason.alias("reason"), F.when(state == "written", 1).when(state == "unchanged", 0).alias("changed"), F.col("fields").alias("changed_fields"))
        outcomes = self.store.write("outcomes", outcomes)
        self.store.write("raw", dml.marked_dead(merged, strikes, now))
        self.store.write("items", dml.recorded(self.items, outcomes, now))
        counts = {r["state"]: r["n"] for r in outcomes.groupBy("state").agg(F.count("*").alias("n")).collect()}
        order = todo.join(outcomes, "db_id").select(F.lit(0).alias("run_id"), F.row_number().over(_by_queue()).alias("seq"), "http_status")
        streak = sync.breaker(order, BREAKER).first()
        result.batch = {"fetched": sum(counts.values()), **{s: counts.get(s, 0) for s in ("written", "unchanged", "skipped", "transient")}, "in_row": int(streak["longest"] or 0) if streak else 0}


def _by_queue():
    """One batch in its queue's order: no more rows than a batch has."""
    from pyspark.sql import Window

    return Window.partitionBy().orderBy(*sync.queue_order())


def lines(result: Outcome, options: Options) -> list[str]:
    """A sync's report as text."""
    out = [f"{r['cohort']:<12}{r['n']:>10}" + (f"   {r['first_id']} to {r['last_id']}" if r["n"] else "") for r in result.plan]
    queue = next((r["n"] for r in result.plan if r["cohort"] == "queue"), None)
    if queue is not None:
        out.append(f"about {round(queue * fetch.PACE / 60)} minutes in {-(-queue // options.batch)} batches")
    out += [f"batch {k}: {v}" for k, v in result.batch.items()] + [f"run {k}: {v}" for k, v in result.totals.items()]
    return out + result.notes

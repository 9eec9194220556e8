"""The queries that a caller can ask, over one corpus.

An engine chooses between the full scan and the index by the size of the corpus, adds what the
corpus can say about its currency, and keeps small finished results by corpus version.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from time import monotonic
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import freshness, record
from quarry.functions.freshness import Freshness
from quarry.functions.text import query_tokens
from quarry.operators import index, search, support

#: Seconds that a finished result is kept, and how many are.
KEEP_SECONDS, KEEP = 3600, 1024
#: Records from which on find_supporting leaves the texts alone, given a phrase index.
INDEX_FROM = 1_000_000
NOUNS = "inquiries"
NAME, VERSION = "quarry", "0.2.0"


class Source(Protocol):
    """Where an engine's corpus comes from: anything that gives the served table."""

    def corpus(self) -> DataFrame: ...


@dataclass
class Cache:
    """Finished results by key, the oldest out first. Only rows that a caller was shown anyway."""

    seconds: float = KEEP_SECONDS
    most: int = KEEP
    clock: Callable[[], float] = monotonic
    held: OrderedDict[str, tuple[float, Any]] = field(default_factory=OrderedDict)

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        value = make()
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return value


class SharedCache:
    """Finished results as files in a folder that several engines share, under a namespace that a new corpus changes.

    Nothing that goes wrong here reaches the caller: a result that can't be read is made again, one
    that can't be kept is only returned. Results are as JSON gives them back, kept or not.
    """

    def __init__(self, spark: SparkSession, folder: str, namespace: str, seconds: float = KEEP_SECONDS, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.seconds, self.clock = spark, f"{folder.rstrip('/')}/{hashlib.sha256(namespace.encode()).hexdigest()}", seconds, clock

    def _at(self, key: str) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}.json")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        with contextlib.suppress(Exception):
            files, path = self._at(key)
            if files.exists(path):
                stream = files.open(path)
                try:
                    held = json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
                if held["key"] == key and self.clock() - held["at"] < self.seconds:
                    return held["value"]
        value = make()
        text = json.dumps({"key": key, "at": self.clock(), "value": value}, default=_plain)
        with contextlib.suppress(Exception):
            files, path = self._at(key)
            stream = files.create(path, True)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
        return json.loads(text)["value"]


def _plain(value: Any) -> Any:
    return asdict(value) if isinstance(value, Freshness) else str(value)


class Engine:
    def __init__(self, corpus: DataFrame | Source, found: index.Index | None = None, version: str = "", cache: Cache | SharedCache | None = None, phrases: index.PhraseIndex | None = None) -> None:
        self.corpus, self.version = corpus if isinstance(corpus, DataFrame) else corpus.corpus(), version
        self.index, self.phrases = found, phrases
        self.cache = cache or Cache()

    def _kept(self, op: str, params: dict[str, Any], make: Callable[[], Any]) -> Any:
        return self.cache.get(f"{self.version}:{op}:{json.dumps(params, sort_keys=True, default=str)}", make)

    def freshness(self) -> Freshness | None:
        """What the corpus says of itself; nothing rather than a half."""

        def read() -> Freshness | None:
            row = freshness.summary(self.corpus).first()
            return Freshness(row["current_through"], row["synced_at"], row["record_count"]) if row else None

        known = self._kept("freshness", {}, read)
        return Freshness(**known) if isinstance(known, dict) else known

    def _dated(self, payload: dict[str, Any], note: str | None = None) -> dict[str, Any]:
        known = self.freshness()
        if known:
            payload |= {"corpus_current_through": known.current_through, "corpus_synced_at": known.synced_at}
            if note:
                payload["corpus_note"] = note
        return payload

    def _recency(self, query: str | None) -> str | None:
        known = self.freshness()
        return freshness.recency_note(known, NOUNS) if known and freshness.implies_recency(query, int(known.current_through[:4])) else None

    def search(self, query: str | None = None, limit: int | None = None, offset: int = 0, filters: dict[str, Any] | None = None, indexed: bool = False) -> dict[str, Any]:
        """Hits by coverage of the query's words, or by BM25 over the index."""
        most = search.clamped(limit, search.SEARCH_LIMIT)

        def ask() -> dict[str, Any]:
            if indexed and query:
                rows = index.search_indexed(self.corpus, self._index(), query, filters, most, max(0, offset))
            else:
                rows = search.search(self.corpus, query, filters, most, max(0, offset))
            found = [r["hit"].asDict(True) for r in rows.select(search.hit_payload().alias("hit")).collect()]
            return {"count": len(found), "results": found}

        return self._dated(dict(self._kept("search", {"q": query, "l": most, "o": offset, "f": filters, "i": indexed}, ask)), self._recency(query))

    def get(self, ident: str | int) -> dict[str, Any]:
        def ask() -> dict[str, Any]:
            row = search.get_by_id(self.corpus, ident).withColumn("citation", record.citation()).first()
            return {"found": row is not None, **({"item": row.asDict(True)} if row else {})}

        return self._dated(dict(self._kept("get", {"id": str(ident)}, ask)))

    def list_recent(self, since: str | None = None, limit: int | None = None) -> dict[str, Any]:
        most = search.clamped(limit, search.SEARCH_LIMIT)
        known = self.freshness()
        note = None
        if known:
            note = freshness.beyond_note(known, NOUNS) if freshness.beyond(since, known) else freshness.recency_note(known, NOUNS)

        def ask() -> dict[str, Any]:
            rows = search.list_recent(self.corpus, since, most).withColumn("citation", record.citation()["short_form"])
            return {"items": [r.asDict(True) for r in rows.collect()]}

        return self._dated(dict(self._kept("recent", {"s": since, "l": most}, ask)), note)

    def find_supporting(self, ask: support.Ask, limit: int | None = None, indexed: bool | None = None) -> dict[str, Any]:
        """Records for a line item with the parts of their scores.

        By the scan; on a large corpus by the phrase index, which gives the same; or, if asked
        for, out of the bounded pool of candidates.
        """
        most = search.clamped(limit, search.FIND_LIMIT)
        through = bool(indexed)

        def run() -> dict[str, Any]:
            if indexed is None and self.phrases is not None and self._large():
                rows = support.find_supporting_exact(self.corpus, self.phrases, ask, most)
            elif through:
                rows = support.find_supporting_indexed(self.corpus, self._index(), ask, most) if query_tokens(ask.query) else None
            else:
                rows = support.find_supporting(self.corpus, ask, most)
            found = [r["hit"].asDict(True) for r in rows.select(support.payload().alias("hit")).collect()] if rows is not None else []
            for hit in found:
                hit["confidence"] = rounded(hit["confidence"])
                hit["breakdown"] |= {p: rounded(hit["breakdown"][p]) for p in support.PARTS[:3]}
            return {"results": found}

        return self._dated(dict(self._kept("find", {**asdict(ask), "l": most, "i": through}, run)), self._recency(ask.query))

    def find_documents(self, query: str) -> dict[str, Any]:
        """The connector's search: ten hits as id, title, text and url."""
        hits = self.search(query, 10)["results"]
        return {"results": [{"id": h["id"], "title": h["title"], "text": h["snippet"] or "", "url": h["url"]} for h in hits]}

    def fetch_document(self, ident: str | int) -> dict[str, Any]:
        """The connector's fetch: one record as one labelled text; a miss keeps the shape."""
        row = documents(search.get_by_id(self.corpus, ident)).first()
        if row is None:
            return {"id": str(ident), "title": "", "text": "", "url": "", "metadata": {"found": False}}
        told = {k: v for k, v in row["metadata"].asDict().items() if v is not None or k == "ip"}
        return {"id": row["id"], "title": row["title"], "text": row["text"], "url": row["url"], "metadata": {"found": True, **told}}

    def describe(self, text: str) -> str:
        """A tool description with the corpus's currency, where it is known."""
        known = self.freshness()
        return f"{text}\n\n{freshness.sentence(known, NOUNS)}" if known else text

    def health(self) -> dict[str, Any]:
        """Whether the corpus answers, its size and currency, and whether the version in use is that of its last sync; an error is an answer too."""
        try:
            records, known = self._size(), self.freshness()
        except Exception as error:  # noqa: BLE001
            return {"ok": False, "error": str(error)}
        state = {"ok": records > 0, "server": NAME, "version": VERSION, "corpus_version": self.version or None, "corpus_version_stale": self.version != known.synced_at if known else None, "records": records}
        return self._dated(state)

    def _size(self) -> int:
        return self._kept("size", {}, lambda: self.corpus.agg(F.count("*")).first()[0])

    def _large(self) -> bool:
        return self._size() >= INDEX_FROM

    def _index(self) -> index.Index:
        if self.index is None:
            self.index = index.build(self.corpus)
        return self.index


def documents(corpus: DataFrame) -> DataFrame:
    """Records as a connector's documents: id, title, url, the labelled text, and eleven keys of metadata."""
    cited = record.citation()
    metadata = F.struct(
        cited["short_form"].alias("citation"), cited["long_form"].alias("citation_long"), "ip", "status", "inquiry_type", "area_of_vehicle",
        "vehicle_year", "vehicle_make", "vehicle_model", record.iso(F.col("submitted_at")).alias("submitted_at"), record.iso(F.col("resolved_at")).alias("resolved_at"),
    )
    return corpus.select("id", "title", "url", record.flattened().alias("text"), metadata.alias("metadata"))


def rounded(value: float) -> float:
    """Three decimals of the exact binary value, halves up: 1.0005, which is a little less, gives 1.0."""
    return float(Decimal(value).quantize(Decimal("0.001"), ROUND_HALF_UP))


def encoded(payload: dict[str, Any]) -> dict[str, Any]:
    """A payload as text and as it is, for callers that read either."""
    return {"text": json.dumps(payload, default=str, ensure_ascii=False, indent=2), "structured": payload}

"""find_supporting: records that support a line item, scored in parts that can be explained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import record, text
from quarry.operators import index

#: Fixed boosts, and the days within which a record counts as recent.
PROVIDER_BOOST, VEHICLE_BOOST, VEHICLE_CAP, OPERATION_BOOST, RECENCY_BOOST = 0.15, 0.1, 0.3, 0.1, 0.05
RECENT_MS = 720 * 24 * 60 * 60 * 1000
POOL = 500
PARTS = ("bigram", "unigram", "text", "ip", "vehicle", "operation", "recency")


@dataclass(frozen=True)
class Ask:
    """A line item in words, the vehicle it is for, and the instant that counts as now."""

    query: str
    now: str
    vehicle_year: int | None = None
    vehicle_make: str | None = None
    vehicle_model: str | None = None


def parts(ask: Ask, shares: tuple[Column, Column, Column] | None = None) -> dict[str, Column]:
    """Every part of the score. Doubles, added from left to right in the order of PARTS.

    ``shares`` are the bigram share, the unigram share and the text score, if known without the texts.
    """
    bigram, unigram, words = shares or text.text_parts(ask.query)
    provider = record.query_provider(ask.query)
    zero = F.lit(0.0)
    ip = F.when(F.col("ip") == provider, PROVIDER_BOOST).otherwise(0.0) if provider else zero
    vehicle = zero
    if ask.vehicle_year is not None:
        vehicle = vehicle + F.when(F.col("vehicle_year") == ask.vehicle_year, VEHICLE_BOOST).otherwise(0.0)
    for name, value in (("vehicle_make", ask.vehicle_make), ("vehicle_model", ask.vehicle_model)):
        if value:
            vehicle = vehicle + F.when(F.contains(F.lower(F.col(name)), F.lit(value.lower())), VEHICLE_BOOST).otherwise(0.0)
    operation = F.lit(False)
    for token in text.query_tokens(ask.query):
        operation = operation | F.contains(F.lower("inquiry_type"), F.lit(token))
    age = F.unix_millis(F.lit(ask.now).cast("timestamp")) - F.unix_millis(F.coalesce("resolved_at", "submitted_at"))
    return {
        "bigram": bigram,
        "unigram": unigram,
        "text": words,
        "ip": ip,
        "vehicle": F.least(F.lit(VEHICLE_CAP), vehicle),
        "operation": F.when(operation, OPERATION_BOOST).otherwise(0.0),
        "recency": F.when((age >= 0) & (age <= RECENT_MS), RECENCY_BOOST).otherwise(0.0),
    }


def scored(corpus: DataFrame, ask: Ask, shares: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """The corpus with the parts as columns, and their sum held between 0 and 1 as ``score``."""
    rows = corpus.withColumns(parts(ask, shares))
    total = sum((F.col(p) for p in PARTS[3:]), F.col("text"))
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """By score, then effective date, then id, each from the top: a total order, so no ties are left to chance."""
    return rows.orderBy(F.desc("score"), F.desc(F.coalesce("resolved_at", "submitted_at")), F.desc("db_id")).limit(limit)


def find_supporting(corpus: DataFrame, ask: Ask, limit: int = 5) -> DataFrame:
    """Every record scored; rows without a hit stay. The narrow columns are ranked, then joined with nothing: one pass."""
    return ranked(scored(corpus, ask), limit).withColumn("snippet", text.snippet_token(ask.query))


def pool(corpus: DataFrame, postings: index.Index, query: str, size: int = POOL) -> DataFrame:
    """Ids of the candidates: the best by BM25, and the newest among all that match."""
    hits = index.bm25(postings, query)
    best = hits.orderBy("rank", "db_id").limit(size).select("db_id")
    dates = corpus.select("db_id", F.coalesce("resolved_at", "submitted_at").alias("effective_at"))
    newest = dates.join(hits.select("db_id"), "db_id").orderBy(F.desc("effective_at"), F.desc("db_id")).limit(size).select("db_id")
    return best.unionByName(newest).distinct()


def find_supporting_indexed(corpus: DataFrame, postings: index.Index, ask: Ask, limit: int = 5, size: int = POOL) -> DataFrame:
    """The same ranking over a bounded pool of candidates; a query without tokens has none."""
    candidates = pool(corpus, postings, ask.query, size)
    return ranked(scored(corpus.join(candidates, "db_id", "left_semi"), ask), limit).withColumn("snippet", text.snippet_token(ask.query))


NARROW = ("db_id", "ip", "inquiry_type", "vehicle_year", "vehicle_make", "vehicle_model", "submitted_at", "resolved_at")


def find_supporting_exact(corpus: DataFrame, phrases: index.PhraseIndex, ask: Ask, limit: int = 5) -> DataFrame:
    """The scan's answer without reading the texts: their share of the score comes from the phrase index.

    All records are ranked, on their narrow columns; only the ``limit`` best are read in full.
    """
    tokens = text.query_tokens(ask.query)
    shares = [F.coalesce(F.col(c), F.lit(0)) / F.lit(float(n)) if n else F.lit(0.0) for c, n in (("bigrams", len(tokens) - 1 if tokens else 0), ("unigrams", len(tokens)))]
    words = F.least(F.lit(1.0), shares[0] * text.BIGRAM_WEIGHT + shares[1] * text.UNIGRAM_WEIGHT)
    rows = corpus.select(*NARROW).join(index.phrase_hits(phrases, ask.query), "db_id", "left")
    best = ranked(scored(rows, ask, (shares[0], shares[1], words)), limit).select("db_id", *[F.col(p).alias(f"_{p}") for p in (*PARTS, "score")])
    whole = corpus.join(F.broadcast(best), "db_id").withColumns({p: F.col(f"_{p}") for p in (*PARTS, "score")})
    return ranked(whole, limit).withColumn("snippet", text.snippet_token(ask.query)).drop(*[f"_{p}" for p in (*PARTS, "score")])


def payload() -> Column:
    """What a hit tells: confidence and the parts of the score, vehicle, snippet and citation. Rounding is left to the caller."""
    return F.struct(
        F.col("id"),
        F.col("score").alias("confidence"),
        F.struct(*PARTS, F.col("score").alias("total")).alias("breakdown"),
        F.struct("vehicle_year", "vehicle_make", "vehicle_model").alias("vehicle"),
        "snippet",
        record.citation().alias("citation"),
    )

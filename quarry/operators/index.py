"""An inverted index as derived tables, and field-weighted BM25 over it.

postings(term, db_id, f) hold the weighted occurrences of a term in a record, already summed over
its fields, so a long record is one row per term. A query meets the dictionary first (a few exact
terms and prefixes), and only the postings of the matching terms after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

#: Fixed weights of the indexed fields, and BM25's two constants.
WEIGHTS = {
    "title": 8.0, "issue_summary": 4.0, "suggested_action": 3.0, "resolution": 4.0, "inquiry_type": 2.0,
    "area_of_vehicle": 1.0, "vehicle_make": 0.5, "vehicle_model": 0.5, "body": 0.5,
}
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Accented letters and what the index takes them for.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, db_id, f
    lengths: DataFrame  # db_id, n_tokens


@dataclass(frozen=True)
class PhraseIndex:
    """The words and neighbouring words of the text that is scored, each once a record."""

    words: DataFrame  # word, db_id
    pairs: DataFrame  # first, second, db_id


def build_phrases(corpus: DataFrame) -> PhraseIndex:
    """The tables from which the text score can be had without the texts: distinct before any shuffle."""
    body = F.split(text.normalise(F.concat_ws(" ", "issue_summary", "suggested_action", "resolution")), " ")

    def both(w: Column) -> Column:
        near = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        # distinct as text, which is hashed; the last word has no next one and gives null
        return F.struct(F.array_distinct(w).alias("words"), F.array_distinct(F.array_compact(near)).alias("pairs"))

    rows = corpus.select("db_id", text.let(body, both).alias("t"))
    words = rows.select("db_id", F.explode_outer("t.words").alias("word")).filter("word != ''")
    pairs = rows.select("db_id", F.explode_outer("t.pairs").alias("p")).filter("p is not null")
    return PhraseIndex(words.select("word", "db_id"), pairs.select(F.substring_index("p", " ", 1).alias("first"), F.substring_index("p", " ", -1).alias("second"), "db_id"))


def phrase_hits(found: PhraseIndex, query: str) -> DataFrame:
    """(db_id, unigrams, bigrams): how many of the query's tokens and pairs a record contains, inside words too.

    A token holds no blank, so a text contains it if one of its words does; it contains a pair if
    a word that ends with the first stands before one that begins with the second.
    """
    tokens = text.query_tokens(query)
    couples = list(zip(tokens, tokens[1:], strict=False))
    zero = F.lit(0)

    def counted(table: DataFrame, tests: list[Column], name: str) -> DataFrame:
        if not tests:
            return table.select("db_id").filter(F.lit(False)).withColumn(name, zero)
        either = tests[0]
        for t in tests[1:]:
            either = either | t
        flags = [F.max(t.cast("int")).alias(f"t{i}") for i, t in enumerate(tests)]
        return table.filter(either).groupBy("db_id").agg(*flags).select("db_id", sum((F.col(f"t{i}") for i in range(len(tests))), zero).alias(name))

    singles = counted(found.words, [F.contains(F.col("word"), F.lit(t)) for t in tokens], "unigrams")
    doubles = counted(found.pairs, [F.endswith(F.col("first"), F.lit(a)) & F.startswith(F.col("second"), F.lit(b)) for a, b in couples], "bigrams")
    return singles.join(doubles, "db_id", "full_outer").select("db_id", F.coalesce("unigrams", zero).alias("unigrams"), F.coalesce("bigrams", zero).alias("bigrams"))


def folded(column: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(column), ACCENTED, PLAIN)


def terms(column: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.regexp_extract_all(folded(F.coalesce(column, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def build(corpus: DataFrame) -> Index:
    """The index of a corpus. Occurrences are summed per record and term before they are shuffled."""
    fields = F.array(*[F.struct(F.lit(w).alias("weight"), terms(F.col(c)).alias("terms")) for c, w in WEIGHTS.items()])
    # outer, then a filter: for an inner explode the optimizer would work the arrays out once more to drop empty ones
    each = corpus.select("db_id", F.explode_outer(fields).alias("f")).select("db_id", "f.weight", F.explode_outer("f.terms").alias("term")).filter("term is not null")
    postings = each.groupBy("term", "db_id").agg(F.sum("weight").alias("f"))
    size = sum((F.size(terms(F.col(c))) for c in WEIGHTS), F.lit(0))
    return Index(postings, corpus.select("db_id", size.cast("long").alias("n_tokens")))


def updated(old: Index, corpus: DataFrame, changed: DataFrame) -> Index:
    """The index after changes: the changed ids' entries go, those still in the corpus come anew."""
    new = build(corpus.join(changed.select("db_id"), "db_id", "left_semi"))
    keep = changed.select("db_id")

    def kept(table: DataFrame) -> DataFrame:
        return table.join(keep, "db_id", "left_anti").select(*table.columns)

    return Index(kept(old.postings).unionByName(new.postings), kept(old.lengths).unionByName(new.lengths))


def phrases(query: str) -> list[tuple[int, str, bool]]:
    """(number, token, prefix?) of a query; a repeated token is a phrase of its own."""
    return [(i, t, len(t) >= text.MIN_PREFIX) for i, t in enumerate(text.query_tokens(query))]


def matches(term: Column, query: str) -> Column:
    """The numbers of the phrases that a term matches."""
    return F.array_compact(F.array(*[F.when(F.startswith(term, F.lit(t)) if prefix else term == t, F.lit(i)) for i, t, prefix in phrases(query)]))


def hits(found: Index, query: str) -> DataFrame:
    """(phrase, db_id, f): weighted occurrences of every phrase."""
    if not phrases(query):
        return found.postings.filter(F.lit(False)).select(F.lit(0).alias("phrase"), "db_id", "f")
    wanted = F.lit(False)
    for _, t, prefix in phrases(query):
        wanted = wanted | (F.startswith(F.col("term"), F.lit(t)) if prefix else F.col("term") == t)
    rows = found.postings.filter(wanted)
    return rows.select(F.explode(matches(F.col("term"), query)).alias("phrase"), "db_id", "f").groupBy("phrase", "db_id").agg(F.sum("f").alias("f"))


def fts_match(found: Index, query: str) -> DataFrame:
    """Ids of the records that match any phrase."""
    return hits(found, query).select("db_id").distinct()


def bm25(found: Index, query: str) -> DataFrame:
    """(db_id, rank), the lower the better; a query without tokens ranks nothing.

    The corpus's size and mean length are one row, a phrase's frequency one row a phrase: both
    are scalar-sized whatever the corpus, and broadcast as such.
    """
    per = hits(found, query)
    frequency = per.groupBy("phrase").agg(F.count("*").alias("n"))
    corpus = found.lengths.agg(F.count("*").alias("n_records"), F.avg("n_tokens").alias("mean"))
    idf = F.log((F.col("n_records") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weight = frequency.join(F.broadcast(corpus)).select("phrase", "mean", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    rows = per.join(F.broadcast(weight), "phrase").join(found.lengths, "db_id")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    return rows.groupBy("db_id").agg((-F.sum(part)).alias("rank"))


def search_indexed(corpus: DataFrame, found: Index, query: str, filters: dict | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Records by BM25; the score shown is still the share of the query's words."""
    from quarry.operators.search import predicate

    rows = corpus.filter(predicate(filters)).join(bm25(found, query), "db_id")
    page = rows.orderBy("rank", "db_id").offset(offset).limit(limit)
    return page.withColumn("score", text.coverage(query)).withColumn("snippet", text.snippet_literal(query))

"""Text normalisation, tokens and the two relevance scores, as Column expressions.

The query side is tokenised on the driver (a query is one short string) and enters the plan as
literals; the record side never leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "and", "or",
    "is", "was", "are", "be", "by", "from", "as", "it", "this", "that", "these",
    "those", "i", "we", "they", "them", "us", "our", "their",
)
#: Least length of a token, and of one that matches as a prefix.
MIN_TOKEN, MIN_PREFIX = 2, 3
#: Fixed weights of the text score.
BIGRAM_WEIGHT, UNIGRAM_WEIGHT = 0.7, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def normalise(text: Column) -> Column:
    """Lower case; "X & Y" becomes "XY"; everything but a-z and 0-9 becomes single spaces."""
    joined = F.regexp_replace(F.lower(text), r"(\w)\s*&\s*(\w)", "$1$2")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def normalised(text: str) -> str:
    joined = re.sub(r"([a-zA-Z0-9_])\s*&\s*([a-zA-Z0-9_])", r"\1\2", text.lower())
    return re.sub("[^a-z0-9]+", " ", joined).strip()


def query_tokens(text: str) -> list[str]:
    return [t for t in normalised(text).split(" ") if len(t) >= MIN_TOKEN and t not in STOPWORDS]


def pairs_of(tokens: Sequence[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]


def tokens(text: Column) -> Column:
    """The tokens of a column, in order, duplicates kept."""
    return F.filter(F.split(normalise(text), " "), lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*STOPWORDS))


def bigrams(token_array: Column) -> Column:
    """Neighbouring tokens, joined by one space."""
    return let(
        token_array,
        lambda t: F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(
            F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        ),
    )


def share_contained(haystack: Column, needles: Sequence[str]) -> Column:
    """The share of the needles that the haystack contains as substrings; 0 for no needles."""
    if not needles:
        return F.lit(0.0)
    hits = sum((F.contains(haystack, F.lit(n)).cast("int") for n in needles), F.lit(0))
    return hits / F.lit(float(len(needles)))


SEARCHED = ("title", "issue_summary", "suggested_action", "resolution", "inquiry_type", "area_of_vehicle", "vehicle_make", "vehicle_model", "body")


def haystack() -> Column:
    return F.lower(F.concat_ws(" \n ", *SEARCHED))


def coverage_words(query: str) -> list[str]:
    """Blank-separated words of two or more characters; no stop list, marks and repeats kept."""
    return [w for w in re.split(r"\s+", query.lower()) if len(w) >= MIN_TOKEN]


def coverage(query: str) -> Column:
    """The share of the query's words found anywhere in the record."""
    return F.coalesce(share_contained(haystack(), coverage_words(query)), F.lit(0.0))


def text_parts(query: str) -> tuple[Column, Column, Column]:
    """(bigram share, unigram share, text score) of a record for a query."""
    found = query_tokens(query)
    body = normalise(F.concat_ws(" ", "issue_summary", "suggested_action", "resolution"))
    pairs, singles = share_contained(body, pairs_of(found)), share_contained(body, found)
    return pairs, singles, F.least(F.lit(1.0), pairs * BIGRAM_WEIGHT + singles * UNIGRAM_WEIGHT)


def window(text: Column, at: Column, size: int) -> Column:
    """An excerpt from 60 characters before a hit to 120 after it, marked where it is cut."""
    start = F.greatest(F.lit(0), at - 1 - 60)
    end = F.least(F.length(text), at - 1 + size + 120)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))


def head(text: Column, most: int, mark: str) -> Column:
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, mark).otherwise(""))


EXCERPTED = ("issue_summary", "resolution", "suggested_action")


def snippet(needles: Sequence[str]) -> Column:
    """The excerpt at the first needle found: fields in order, needles in order within a field."""
    found = []
    for field in EXCERPTED:
        text = F.nullif(F.col(field), F.lit(""))
        for needle in needles:
            at = F.instr(F.lower(text), needle) if needle else F.when(text.isNotNull(), F.lit(1))
            found.append(F.when(at > 0, window(text, at, len(needle))))
    issue = F.nullif(F.col("issue_summary"), F.lit(""))
    return F.coalesce(*found, F.when(issue.isNotNull(), head(issue, 200, "…")))


def snippet_literal(query: str) -> Column:
    """The excerpt at the whole query as it stands, whatever its case."""
    return snippet([query.lower()])


def snippet_token(query: str) -> Column:
    """The excerpt at the first of the query's tokens."""
    return snippet(query_tokens(query))

"""Language identification, words first, then ever shorter character n-grams.

A known word is scored by its log frequency in every language. An unseen word falls back to the
longest order of character n-grams (with word ends) of which any is known, and scores the mean
of the known ones. A text's score is the mean of its words' scores.

The model is fitted on a bounded sample of labelled rows: about ROWS distinct texts of each language,
chosen by a hash of the text and counted as often as their rows come. That is its documented bound
and with it its size as a broadcast; every word and n-gram of the sample is kept, as a 64-bit hash. Prediction
reads every whole text and nothing else. A word is a run of letters (category L), in both.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text
where nothing was learned; ties go to the language first by code point; equal texts get equal
results, repeated rows as well; texts of any length are read whole; an empty table gives an empty
table; result columns replace input columns of the name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import in_arrow, written

#: Distinct texts of each language that the model learns from, and its longest n-grams.
ROWS, ORDER = 3_000, 5
#: Words that a worker remembers.
KEPT = 200_000
#: Words after which a text's evidence counts as full when the score is formed.
EVIDENCE = 20
LETTERS = r"\p{L}+"
UNKNOWN = "und"


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS) -> dict:
    """The model of (text, lang) rows: languages, row numbers of words and of n-grams by order, log frequencies."""
    pairs = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    texts = pairs.select("lang", F.xxhash64("text").alias("th")).distinct()
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": [], "rows": Items(np.zeros(0, np.int64), 0), "grams": [], "values": np.zeros((0, 0), np.float32)}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, rows / n))) for k, n in sizes.items()])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    number = F.coalesce(*[F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(languages)])
    sample = pairs.filter(draw < share).groupBy("lang", "text").agg(F.count("*").alias("copies"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), F.lit(1))
    counted = sample.select(number.alias("lang"), "copies", F.explode(found).alias("item")).groupBy("lang", "item").agg(F.sum("copies").alias("n"))
    counted = written(counted, "words")
    ends = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    cut = F.flatten(F.array(*[_cut(ends, order) for order in range(1, ORDER + 1)]))
    gram = counted.select("lang", "n", F.explode(cut).alias("item")).filter("item != ' '").select("lang", F.length("item").alias("order"), F.xxhash64("item").alias("h"), "n")
    gram = gram.groupBy("lang", "order", "h").agg(F.sum("n").alias("n"))
    both = counted.select("lang", F.lit(0).alias("order"), F.xxhash64("item").alias("h"), "n").unionByName(gram).toArrow()
    lang, of, h, n = (both.column(c).to_numpy() for c in ("lang", "order", "h", "n"))
    values, items = [], []
    for order in range(ORDER + 1):
        part = of == order
        keys, place = np.unique(h[part], return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (place, lang[part]), n[part])
        items.append(Items(keys, sum(map(len, values))))
        values.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))).astype(np.float32))
    return {"languages": languages, "rows": items[0], "grams": items, "values": np.concatenate(values)}


class Items(Mapping):
    """Words or n-grams to row numbers, by sorted 64-bit hashes: XXH64 of the UTF-8 bytes, with the seed that Spark takes."""

    def __init__(self, keys: np.ndarray, start: int) -> None:
        self.keys_, self.start = keys, start

    def get(self, item: str, default: int | None = None) -> int | None:
        key = xxhash.xxh64_intdigest(item.encode(), 42)
        key -= (key >> 63) << 64
        at = int(self.keys_.searchsorted(key))
        return self.start + at if at < len(self.keys_) and self.keys_[at] == key else default

    def __getitem__(self, item: str) -> int:
        row = self.get(item)
        if row is None:
            raise KeyError(item)
        return row

    def __contains__(self, item: object) -> bool:
        return self.get(str(item)) is not None

    def __len__(self) -> int:
        return len(self.keys_)

    def __iter__(self) -> Iterator[int]:
        return iter(self.keys_.tolist())

    def values(self) -> range:
        return range(self.start, self.start + len(self.keys_))


class Remembered(dict):
    """Words to what is known of them: a row number, the rows of their n-grams, or none. A bounded number is remembered."""

    def __init__(self, look: Callable[[str], int | list[int]]) -> None:
        super().__init__()
        self.look = look

    def __missing__(self, word: str) -> int | list[int]:
        found = self.look(word)
        if len(self) < KEPT and len(word) <= 32:
            self[word] = found
        return found


def _cut(item: Column, order: int) -> Column:
    last = F.length(item) - order + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(item, i, F.lit(order)))).otherwise(F.array().cast("array<string>"))


class Identifier:
    def __init__(self, model: dict) -> None:
        self.languages, self.values, self.words, self.grams = (model[k] for k in ("languages", "values", "rows", "grams"))
        self.found = regex.compile(LETTERS).findall
        self.known = Remembered(lambda w: self.backoff(w) if (row := self.words.get(w)) is None else row)

    def backoff(self, word: str) -> list[int]:
        """Row numbers of the known n-grams of the longest order that has any."""
        ended = f" {word} "
        for order in range(min(ORDER, len(ended)), 0, -1):
            get = self.grams[order].get
            rows = [r for i in range(len(ended) - order + 1) if (r := get(ended[i : i + order])) is not None]
            if rows:
                return rows
        return []

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = self.found(text.lower()) if text else ()
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows = list(map(self.known.__getitem__, words))
        total = self.values[[r for r in rows if isinstance(r, int)]].sum(axis=0, dtype=float)
        parts = [r for r in rows if not isinstance(r, int) and r]
        if parts:
            flat = np.fromiter((r for p in parts for r in p), int)
            weight = np.repeat([1 / len(p) for p in parts], [len(p) for p in parts])
            total = total + weight @ self.values[flat]
        scores = total / len(words)
        best = int(scores.argmax())
        odds = np.exp((scores - scores[best]) * min(len(words), EVIDENCE))
        return self.languages[best], float(1 / odds.sum())


def with_language(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    names, at = [f.name for f in kept], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(shared.value)
        for batch in batches:
            found = [own(x) for x in batch.column(at).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i].lower() not in new]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, *new])

    return in_arrow(docs, run, schema)

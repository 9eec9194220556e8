"""Cross-entropy difference scores from a target and a background n-gram model.

The two bigram models are matched: one vocabulary, one tokenisation, one smoothing. The
vocabulary holds every word of the counted texts, so it and the pair counts grow with the corpus.
Counts are taken over every whole text, all documents for the background and the chosen ones for
the target. A document's score is the mean over its tokens of target loss minus background loss,
in nats: the lower, the more it is like the target.

Smoothing: p(w | h) = (c(h, w) + MU p(w)) / (c(h) + MU), p(w) = (c(w) + 1) / (N + V).

Documents are dealt by hash into chunks of a bounded size. A chunk lists each of its distinct
pairs, histories and words once, as sorted 64-bit keys with the chunk's own counts; ranges of the
keys travel to the ranges' counters as packed difference runs, are summed there over all chunks,
and the sums travel back in the order of the asking chunk's keys. A chunk then works out its
documents' losses from exact counts. A frequent pair costs one entry a chunk, whatever the number
of documents that have it; chunks and ranges grow in number, not in size, with the corpus.

Defined cases: a null text or one without words has no tokens, losses of 0 and score 0; without
target documents the target model is the smoothed one of no counts; a word of no counted text has
c(w) = 0, and V has one place for such words beside the start; repeated rows count as often as
they come and score alike; a null doc_id is nobody's target; an empty table gives an empty table;
texts of any length are read whole; columns other than the id, the text and the flag are not
read, and a result column replaces an input column of its name. A caller that gives a size
gets the words found in most documents, ties to the word first by code point, and for all others
the class of their shape.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import rekeyed, text_of, words_of, written

MU = 8.0
#: Bytes of text of a chunk, and of the texts whose keys fall into one range.
CHUNK_BYTES = 12 << 20
#: Parts over which the documents of one id are dealt.
SALTS = 8
#: Words and shapes that a worker remembers.
WORDS_KEPT, SHAPES_KEPT = 500_000, 200_000
#: The kinds of a key, its lowest two bits.
PAIR, HISTORY, WORD = 0, 1, 2
#: Shapes of words outside the vocabulary, tried in order.
SHAPES = (r"[\W_]*\d[\d\W_]*$", r"[\W_]+$", r".*[#$%&*<>|{}=~^\\]", r".*[!?]{2}", r"\W*[^\W\d_]?[A-ZÀ-Þ]{2,}\W*$", r".*\d", r".{25}", r"[^\W\d_]{1,3}[.,;:]?$", r"[^\W\d_]{4,8}[.,;:]?$", r"")
SHAPE = re.compile("|".join(f"({s})" for s in SHAPES), re.S)


class Tokens(dict):
    """Words, as UTF-8, to token numbers: 0 is a text's start, then the vocabulary, then the shapes.

    Bytes split at exactly the blanks that separate words, and texts come from Arrow as bytes.
    """

    def __init__(self, vocabulary: list[str]) -> None:
        super().__init__({w.encode(): i for i, w in enumerate(vocabulary, 1)})
        self[b""] = 0
        self.known = len(vocabulary)
        self.size = 1 + len(vocabulary) + len(SHAPES)

    def __missing__(self, word: bytes) -> int:
        number = self.known + SHAPE.match(word.decode()).lastindex
        if len(self) < self.known + SHAPES_KEPT and len(word) <= 32:
            self[word] = number
        return number

    def of(self, text: bytes | None) -> np.ndarray:
        """The token numbers of a text, its start first."""
        return np.array(list(map(self.__getitem__, [b"", *text.split()] if text else [b""])), np.uint64)


class Words(dict):
    """All words, as UTF-8, to 64-bit hashes; no bytes are a text's start."""

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) <= 32:
            self[word] = number
        return number

    of = Tokens.of


def vocabulary_of(docs: DataFrame, size: int) -> list[str]:
    """The words of most documents, over all documents."""
    words = docs.select(F.explode(F.array_distinct(words_of(text_of()))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def keys_of(kind: int, h: np.ndarray, w: np.ndarray | int = 0) -> np.ndarray:
    """The keys of pairs, or of histories or words: mixed 62 bits, and the kind."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(kind)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & ~np.uint64(3) | np.uint64(kind)


def packed(*columns: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of equal weight, compressed: small numbers cost next to nothing."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, columns: int) -> np.ndarray:
    """The columns of ``packed``, one a row."""
    planes = np.frombuffer(pa.decompress(data, size * columns * 8, codec="zstd"), np.uint8).reshape(columns, 8, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64).reshape(columns, size)


class Chunk:
    """The texts of a chunk as tokens, and the sorted distinct keys of their pairs, histories and words."""

    def __init__(self, texts: pa.ChunkedArray, tokens: Words | Tokens) -> None:
        rows = [tokens.of(t) for t in texts.cast(pa.large_binary()).to_pylist()]
        #: Tokens of each text, without its start.
        self.sizes = np.array([len(r) - 1 for r in rows], np.int64)
        h, w = (np.concatenate([r[s] for r in rows] or [np.zeros(0, np.uint64)]) for s in (slice(None, -1), slice(1, None)))
        parts = [np.unique(k, return_inverse=True) for k in (keys_of(PAIR, h, w), keys_of(HISTORY, h), keys_of(WORD, w))]
        joined = np.concatenate([k for k, _ in parts])
        order = np.argsort(joined)
        self.keys = joined[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.cumsum([0, *(len(k) for k, _ in parts)])
        #: For every token the places of its pair, history and word among the keys.
        self.places = [place[start : start + len(k)][back] for start, (k, back) in zip(starts, parts, strict=False)]

    def counts(self, times: np.ndarray) -> np.ndarray:
        """How often each key occurs, every text taken as often as told."""
        each = np.repeat(times, self.sizes)
        return sum(np.bincount(p, each, len(self.keys)) for p in self.places).astype(np.uint64)

    def losses(self, counts: np.ndarray, total: int, size: int) -> np.ndarray:
        """Mean -ln p(w | h) of each text."""
        pair, history, word = (counts[p].astype(np.float64) for p in self.places)
        each = np.log(history + MU) - np.log(pair + MU * ((word + 1) / float(total + size)))
        sums = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), each, len(self.sizes))
        return sums / np.maximum(self.sizes, 1)


ASKED = "chunk long, range int, size int, data binary"
TOLD = "chunk long, range int, size int, data binary, words long, n long, t long"


def asks(rows: DataFrame, chosen: DataFrame | None, ranges: int, vocabulary: list[str] | None) -> DataFrame:
    """(chunk, d, text, counted, target), and perhaps (chunk, d) of more targets, to each chunk's keys and counts by range."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["chunk", "range", "size", "data"]

    def listed(part: pa.Table, more: pa.Table | None) -> pa.Table:
        if not part.num_rows:
            return pa.table([[], [], [], []], pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("size", pa.int32()), ("data", pa.binary())]))
        own = Chunk(part.column("text"), Words() if shared.value is None else Tokens(shared.value))
        counted, target = (np.array(part.column(c).to_pylist(), bool) for c in ("counted", "target"))
        if more is not None and more.num_rows:
            ids = set(more.column("d").to_pylist())
            target |= np.array([d in ids for d in part.column("d").to_pylist()], bool)
        n, t = own.counts(counted), own.counts(counted & target)
        cuts = np.searchsorted(own.keys, np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)).tolist() + [len(own.keys)]
        full = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        data = [packed(np.diff(own.keys[a:b], prepend=np.uint64(0)), n[a:b], t[a:b]) for a, b in ((cuts[i], cuts[i + 1]) for i in full)]
        chunk = part.column("chunk")[0].as_py()
        return pa.table([pa.array([chunk] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([cuts[i + 1] - cuts[i] for i in full], pa.int32()), pa.array(data, pa.binary())], names)

    def alone(part: pa.Table) -> pa.Table:
        return listed(part, None)

    def beside(part: pa.Table, more: pa.Table) -> pa.Table:
        return listed(part, more)

    if chosen is None:
        return rows.groupBy("chunk").applyInArrow(alone, ASKED)
    return rows.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(beside, ASKED)


def tells(asked: DataFrame) -> DataFrame:
    """The sums over all chunks of the counts of each asked key, in the order asked; a range's first row has its totals.

    Totals: distinct words that are counted, their occurrences, and those in target texts.
    """

    def run(part: pa.Table) -> pa.Table:
        sizes = part.column("size").to_pylist()
        lists = [unpacked(d, k, 3) for d, k in zip(part.column("data").to_pylist(), sizes, strict=True)]
        keys, back = np.unique(np.concatenate([np.cumsum(x[0]) for x in lists]), return_inverse=True)
        n, t = (np.bincount(back, np.concatenate([x[i] for x in lists]).astype(np.float64), len(keys)).astype(np.uint64) for i in (1, 2))
        word = (keys & np.uint64(3)) == WORD
        cuts = np.cumsum([0, *sizes])
        data = [packed(n[back[a:b]], t[back[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        totals = [pa.array([int(x), *[0] * (len(sizes) - 1)], pa.int64()) for x in ((n[word] > 0).sum(), n[word].sum(), t[word].sum())]
        return pa.table([part.column("chunk"), part.column("range"), part.column("size"), pa.array(data, pa.binary()), *totals], ["chunk", "range", "size", "data", "words", "n", "t"])

    return asked.groupBy("range").applyInArrow(run, TOLD)


def scored(rows: DataFrame, chosen: DataFrame | None, ranges: int, vocabulary: list[str] | None) -> DataFrame:
    """(chunk, d, text, counted, target, wanted), and perhaps (chunk, d) of more targets, to (d, n_tokens, target_loss, background_loss) of the wanted rows."""
    told = written(tells(asks(rows.drop("wanted"), chosen, ranges, vocabulary)), "told")
    words, n, t = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n", "t"))).first()
    size = words + 2 if vocabulary is None else Tokens(vocabulary).size
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["d", "n_tokens", "target_loss", "background_loss"]

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(part.column("text"), Words() if shared.value is None else Tokens(shared.value))
        answers = answers.sort_by("range")
        lists = [unpacked(d, k, 2) for d, k in zip(answers.column("data").to_pylist(), answers.column("size").to_pylist(), strict=True)]
        counts = np.concatenate([*lists, np.zeros((2, 0), np.uint64)], axis=1)
        if counts.shape[1] != len(own.keys):
            raise ValueError("a chunk's rows changed between its two readings")
        found = pa.table([part.column("d"), pa.array(own.sizes), pa.array(own.losses(counts[1], t, size)), pa.array(own.losses(counts[0], n, size))], names)
        return found.filter(part.column("wanted"))

    kind = rows.schema["d"].dataType.simpleString()
    thin = rows.select("chunk", "d", "text", "wanted").groupBy("chunk")
    return thin.cogroup(told.select("chunk", "range", "size", "data").groupBy("chunk")).applyInArrow(run, f"d {kind}, n_tokens long, target_loss double, background_loss double")


def chunks_of(*tables: DataFrame) -> int:
    """The number of chunks for the texts of some tables."""
    return 1 + sum(t.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0] for t in tables) // CHUNK_BYTES


def dealt(chunks: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(chunks)).alias("chunk")


def scores_within(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text) and the ids of the target documents to (doc_id, n_tokens, target_loss, background_loss, score).

    All documents are counted for the background. Ids and texts meet in the chunks, so no text moves for the flag.
    """
    chunks, salt = chunks_of(docs), F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
    at = F.when(F.col("doc_id").isNull(), dealt(chunks, F.col("text"))).otherwise(dealt(chunks, F.col("doc_id"), salt)).alias("chunk")
    rows = docs.select(at, F.col("doc_id").alias("d"), "text", F.lit(True).alias("counted"), F.lit(False).alias("target"), F.lit(True).alias("wanted"))
    ids = chosen.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("d")).filter("d is not null").distinct()
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(dealt(chunks, F.col("d"), F.col("salt")), "d")
    found = scored(rows, ids, chunks, None)
    return found.select(F.col("d").alias("doc_id"), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))


def with_scores(docs: DataFrame, flagged: DataFrame, size: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n_tokens, target_loss, background_loss and score.

    ``flagged`` has the corpus that the models count: text, and whether it belongs to the target.
    """
    vocabulary = None if size is None else vocabulary_of(flagged, size)
    chunks = chunks_of(docs, flagged)
    th = F.xxhash64(text_of())
    counted = flagged.select(F.monotonically_increasing_id().alias("d"), "text", F.lit(True).alias("counted"), F.coalesce("target", F.lit(False)).alias("target"), F.lit(False).alias("wanted"))
    asked = docs.select(th.alias("d"), "text").distinct().select("d", "text", F.lit(False).alias("counted"), F.lit(False).alias("target"), F.lit(True).alias("wanted"))
    rows = written(counted.unionByName(asked), "texts").select(dealt(chunks, F.col("d"), F.col("text")), "*")
    found = scored(rows, None, chunks, vocabulary)
    # equal texts have equal losses
    sums = found.groupBy(F.col("d").alias("__d")).agg(*(F.max(c).alias(f"__{c}") for c in ("n_tokens", "target_loss", "background_loss")))
    new = ("n_tokens", "target_loss", "background_loss", "score")
    own = [c for c in docs.columns if c.lower() not in new]
    joined = docs.withColumn("__d", th).join(rekeyed(sums, "__d"), "__d", "left")
    target, background = F.col("__target_loss"), F.col("__background_loss")
    return joined.select(*[F.col(f"`{c}`") for c in own], *(c.alias(a) for c, a in zip((F.col("__n_tokens"), target, background, target - background), new, strict=True)))

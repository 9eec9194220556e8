"""Line dedup across documents.

A line's key is the line without surrounding blanks, A-Z in lower case. Keys travel as two
64-bit hashes, never as text; texts are split once, and the occurrences written. They are range-partitioned by (key, block of documents) and
sorted by document and position inside, so a stream over each partition sees a key's first
occurrence and every new document in turn. Blocks split a hot key over many partitions; what
remains per key and partition is one partial row, summed afterwards. The answer returned for a
document is its keep bitmap in run form (kept runs of line numbers), not its text; a document
without one keeps all, and only the texts of the others move to meet theirs.

Defined cases: a null or empty text is one empty line; lines without a key are always kept; a
key repeated inside one document counts that document once; rows with equal doc_id and text
count as one document and get the same bitmap, rows that share an id but not the text, or have
no id, count as documents of their own; texts of any length are read whole; an empty table gives
an empty table; columns beyond doc_id and text are passed on unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, let, lower_ascii, parted, rekeyed, text_of, written

#: A key found in so many documents is repeated text.
MIN_DOCS = 10
#: Parts that the documents of one key are dealt over before they are sorted, where there are no more partitions.
BLOCKS = 64
KEY = ["h1", "h2"]
RUNS = "array<struct<start:int,len:int>>"
#: Where a last run ends that goes on to the end of its text.
OPEN = (1 << 31) - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def text_hash() -> Column:
    return F.xxhash64(text_of())


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line that has a key."""
    lines = docs.select("doc_id", text_hash().alias("th"), F.posexplode(lines_of(lower_ascii(text_of()))).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    return lines.select("doc_id", "th", "pos", key.alias("key")).filter("key != ''").select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, keep) of the documents that lose a line: the runs of lines to keep, the last one open.

    Lines whose key occurs in ``min_docs`` documents go, all of them, or all but the first
    occurrence by (doc_id, text hash, position) if ``keep_first``.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("doc_id", "th"), F.lit(max(BLOCKS, n))).cast("int")
    found = written(occurrences(docs), "occurrences")
    ranged = found.withColumn("block", block).repartitionByRange(n, *KEY, "block")
    stream = Window.partitionBy(*KEY, "block").orderBy("doc_id", "th", "pos")
    here = F.struct("doc_id", "th")
    seen = ranged.withColumn("new", F.coalesce(F.lag(here).over(stream) != here, F.lit(True)))
    repeats = seen.groupBy(*KEY).agg(F.sum(F.col("new").cast("long")).alias("n_docs"), F.min(F.when(F.col("new"), F.struct("doc_id", "th", "pos"))).alias("first")).filter(F.col("n_docs") >= min_docs)
    dropped = found.join(rekeyed(repeats.select(*KEY, "first"), *KEY), KEY)
    if keep_first:
        dropped = dropped.filter(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    gone = dropped.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return gone.select("doc_id", "th", kept_runs(F.col("gone"), F.lit(OPEN)).alias("keep"))


def kept_runs(gone: Column, n_lines: Column) -> Column:
    """The runs of kept lines between the dropped line numbers, in order."""
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n_lines)), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` with the columns n_lines, keep (the bitmap in run form) and kept_text; a column of such a name is replaced."""
    bitmaps = keep_bitmaps(docs, min_docs, keep_first).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("keep").alias("__keep"))
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "keep", "kept_text")]
    bitmaps = written(bitmaps, "bitmaps")
    losing, whole_ = parted(docs.withColumn("__own", text_hash()), ["doc_id", "__own"], bitmaps.select("__doc", "__th"))
    joined = losing.join(bitmaps, F.col("__own").eqNullSafe(F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    joined = joined.unionByName(whole_, allowMissingColumns=True)
    lines, whole = lines_of(text_of()), F.col("__keep").isNull()
    n = F.size(lines)
    closed = F.filter(F.transform("__keep", lambda r: F.struct(r["start"].alias("start"), F.least(r["len"], n - r["start"]).alias("len"))), lambda r: r["len"] > 0)
    keep = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), n.alias("len")))).otherwise(closed)
    kept = F.when(whole, text_of()).otherwise(let(lines, lambda x: F.array_join(F.flatten(F.transform("__keep", lambda r: F.slice(x, r["start"] + 1, r["len"]))), "\n")))
    return joined.select(*[F.col(f"`{c}`") for c in own], n.cast("long").alias("n_lines"), keep.cast(RUNS).alias("keep"), kept.alias("kept_text"))

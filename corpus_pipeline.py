"""Raw documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents,
with n_chars following the text; columns beyond those are passed on as they are, whatever their
names, as they travel beside the operators in one struct.

Defined cases: a null or empty text is rejected by the first stage; a document all of whose
lines go in the second keeps its row with an empty text, which links with nothing in the third,
has size 0 in the fourth and no tokens in the fifth. The third stage leaves one row of every
group: rows under one doc_id are one group, rows without a doc_id group by their texts like all
others and come after those with one, and of several rows of the smallest doc_id one stays, the
first by hash. Texts of any length are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, linededup, minhash, mixing, quality
from quarry.llm.common import documents, dropped, parted, rekeyed, written

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: What an operator is to replace.
OWN = ("text", "n_chars")
#: Rows without a doc_id get numbers from here on.
NO_ID = 1 << 62


def aside(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, and all other columns as one, out of the way of the operators' results."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OWN]
    return docs.select("doc_id", "text", F.struct(*rest).alias("__rest"))


def with_text(done: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns that ``aside`` put away, with another column as the text and n_chars counted anew."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return done.select(*[new[c.lower()].alias(c) if c.lower() in new else F.col(f"__rest.`{c}`").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others go on without their failing lines."""
    return with_text(quality.measured(aside(docs)).filter("kept"), docs.columns, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that ten documents or more have, the first occurrence stays."""
    return with_text(linededup.deduplicated(aside(docs), keep_first=True), docs.columns, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays, one with the smallest id."""
    number = F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)))
    rows = docs.select(number.alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    thin = rows.select("doc_id", "text")
    found = minhash.groups(thin, percent=80, shingle=5)
    gone = F.col("doc_id") != F.col("component_id")
    marks = found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(gone).alias("__gone"), (F.count("*") > 1).alias("__twice")).filter("__gone or __twice")
    marks = written(marks, "marks")
    marked, clear = parted(rows, ["doc_id"], marks.select("__id"))
    met = marked.join(rekeyed(marks, "__id"), F.col("doc_id") == F.col("__id"), "left")
    alone = clear.unionByName(met.filter("__id is null").select(*clear.columns)).select("__row.*")
    # rows that share their number are few: only they are looked at together
    one = met.filter("__twice and not __gone").groupBy("doc_id").agg(F.min_by("__row", F.struct(F.xxhash64("text"), F.hash("__row"))).alias("__row")).select("__row.*")
    return alone.unionByName(one)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of the whole text."""
    done = bpe.with_ids(docs.select("doc_id", "source", "text"), VOCABULARY, PATTERN)
    return done.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("byte bpe", tokens)]

#: Shingle similarity and the merges of a vocabulary are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights.

Words are counted per source, each source gets a target share of the whole, and every document
is emitted floor(rate) times, plus once more where a hash of its id falls below the fraction.
The draw depends on the id and the text alone, so reruns and lost executors change nothing, and
rows that share an id, or have none, draw apart.

Defined cases: a null text has size 0; null is a source of its own, ordered last; a null doc_id
draws as the id 'null'; rows that repeat id and text are mixed row by row and draw alike; a source without
words has target 0 and its documents are taken once more or less as any other's rate of 0: not
at all; an empty table gives an empty table. Other columns are passed through untouched by
``repeated``; ``rates`` returns only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_of, written

#: Words of the mix for each word of the input; how often a document's words may be taken.
SHARE, CEILING = 1.5, 2.0
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
DRAW_RANGE = 1 << 32
#: Sources up to which their targets are broadcast, and the parts of a source beyond that.
FEW, SALTS = 100_000, 64


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight under a ceiling.

    The level of the fill is found in one pass: with the sources sorted by ceiling / weight, the
    sources at their ceiling are a prefix, and the level is what remains divided by the weights
    that remain. One row per source, so the single-partition sort holds sources, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    level = Window.orderBy("fill", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("most", ceiling * F.col("source_size"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    # The first source whose ceiling is above the level there sets the level of all that follow.
    level_met = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(every)["level"]
    return filled.select(
        "source",
        "source_size",
        F.when(level_met.isNull(), F.col("most")).otherwise(F.least("most", level_met * F.col("weight"))).alias("target"),
    )


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id and the text: the first 32 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / DRAW_RANGE


def with_targets(docs: DataFrame, thin: DataFrame) -> DataFrame:
    """``docs`` with __source, __size and __target, its source's words and target; no row moves where sources are few.

    ``thin`` (source, size) is what is counted. The targets are written first, so their number is
    known: up to FEW rows they are broadcast; more of them meet the documents by shuffle, every
    source dealt over SALTS parts, as one source may hold a third of the documents.
    """
    plan = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = written(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")), "targets")
    if plan.count() <= FEW:
        return docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source")))
    parts = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(parts, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__part")


def rate() -> Column:
    return F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(0.0)


def rates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies. No text moves."""
    thin = docs.select("doc_id", "source", size_of(text_of()).alias("size"), draw(F.col("doc_id"), text_of()).alias("__draw"))
    thin = written(thin, "sizes")
    joined = with_targets(thin, thin.select("source", "size"))
    return joined.select("doc_id", "source", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), copies_of(rate(), F.col("__draw")).alias("copies"))


def copies_of(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(drawn < rate - whole, 1).otherwise(0)).cast("long")


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; the columns stay as they are."""
    joined = with_targets(docs, docs.select("source", size_of(text_of()).alias("size")))
    copies = joined.withColumn("__copies", copies_of(rate(), draw(F.col("doc_id"), text_of()))).filter("__copies > 0")
    return copies.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])

"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, credentials, langid, linededup, lmscore, mainhtml, minhash, mixing, mpegts, quality
from quarry.llm.common import documents
from quarry.llm.oracles import ORACLES  # noqa: F401


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line figures of every document, the base rules and the line-first verdict."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.measured(documents(spark, sf_dir).select("doc_id", "text")).select(*cols)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return mainhtml.with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's tokens and the bytes that they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.with_bytes(bpe.with_ids(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "ids"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out).select("text", "lang"))
    return langid.with_language(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text: strong ones, and weak parts that belong together."""
    found = credentials.findings(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["name"].isin(*credentials.BASE))
    counts = [F.size(F.filter("spans", credentials.named(k))).cast("long").alias(f"n_{k}") for k in credentials.BASE]
    return found.select("doc_id", *counts, F.sha2(F.encode(credentials.listed(base), "UTF-8"), 256).alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: the target are those labelled as of quality."""
    chosen = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return lmscore.scores_within(documents(spark, sf_dir).select("doc_id", "text"), chosen)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at 85 % of the three-word shingles; the smallest id stays."""
    found = minhash.groups(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a transport stream, and what reading the stream gives."""
    done = mpegts.with_features(mpegts.with_media(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "media"))
    entries = F.size(F.filter("times", lambda t: t["random_access"]))
    feature = F.format_string("packets=%d;errors=%d;streams=%d;pes=%d;entries=%d;last_pts=%d", "packets", "errors", "streams", F.size("times"), entries, F.coalesce(F.get("times", F.size("times") - 1)["pts"], F.lit(-1)))
    return done.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target, and the words that the mix takes of it."""
    return mixing.rates(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document; digest of what stays."""
    done = linededup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.aggregate("keep", F.lit(0), lambda n, r: n + r["len"])
    return done.select("doc_id", "n_lines", (F.col("n_lines") - kept).alias("n_dropped"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_byte_bpe, op4_language_id, op5_secret_scan, op6_lm_scoring, op7_minhash_dedup, op8_mpeg_ts, op9_mixing, op10_line_dedup)}

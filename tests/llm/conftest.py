from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows; with columns whose names clash with results."""

    def build(rows, extra=True):
        full = [r if isinstance(r, tuple) else (i, r, "en", "src0") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("kept", "ids", "n_lines", "keep", "gone", "th", "score", "lang_pred", "media", "n_bytes", "size", "rep", "h1", "clean_text", "decoded"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}

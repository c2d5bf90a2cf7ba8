"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage
returns as Parquet into the shared folder and gives it to the next one. All but
the last return the columns of ``documents``:

1. quality rules: documents outside the usual range of their language and source go;
2. line dedup: of lines that ten or more documents have only the one in the
   document with the smallest id stays; documents with no other line left go;
3. near-dedup: of each group of near copies (five-word shingles, similarity 0.8 or more),
   linked by SimHash and pivot tables first and then exactly, the smallest id stays;
4. secret scan: secrets are masked in the text;
5. best-fit packing: a row for each piece of a document with its sequence and place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import materialize
from quadrille.llm.line_dedup import line_dedup
from quadrille.llm.near_copies import near_copy_dedup
from quadrille.llm.packing import pack_documents
from quadrille.llm.quality import quality_filter
from quadrille.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that had a word and lost all its lines with words is dropped; ``n_chars`` is set anew."""
    words = r"[^\x20\x09-\x0D]"
    kept = line_dedup(docs, keep="first", counts=True)
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(words)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copy_dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fingerprints, the lexer and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage reads what the one before it wrote, as (spark, docs, sf_dir), and all
but the last return the columns of documents. run() applies them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import decontamination, langid, neardup, packing, pii
from spandrel.llm.common import forget, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, and texts without a letter."""
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id, once."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind, and counts characters anew."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences, with the ids' checksum."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", private), ("packing", pack)]

#: Models, sketches and tokenizers have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

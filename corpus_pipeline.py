"""A training corpus from `documents`: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's result into the shared folder and reads it back for the next one.

Defined cases: a document with null or empty text is rejected by the first stage; rows with equal or null ids are judged by their
own texts; columns of other names pass through; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribuna.llm import decontam, neardup, packing, quality, secretscan
from tribuna.llm.common import materialise, table

#: Not expressible: the first stage fits a classifier, the last tokenises.
ORACLE_SQL = None


def _recounted(df: DataFrame) -> DataFrame:
    """n_chars of texts that a stage may have changed."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and all others."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go."""
    return _recounted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark."""
    return _recounted(secretscan.redact_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", neardup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

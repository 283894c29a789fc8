"""From raw documents to a training mix: five stages, each one operator over all its predecessor kept.

Every stage takes and returns a table of documents (doc_id, text, lang, source, n_chars
and whatever further columns came in); the last one returns the mix. Between two
stages the table is written as Parquet and read again, so a lost executor costs at
most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, mixing, pii, quality_cnn, simhash_dedup
from lexloom.llm.common import table
from lexloom.session import apply_settings, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    apply_settings(spark)
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.classify(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    apply_settings(spark)
    return simhash_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    apply_settings(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are masked in the text; no document goes."""
    apply_settings(spark)
    return pii.redacted(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in words, repeats counted."""
    apply_settings(spark)
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: No SQL: the network, the fingerprints and the redaction have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


Q = {"pipeline": (run, ORACLE_SQL)}

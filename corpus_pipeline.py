"""The corpus pipeline: quality, language, near-duplicates, benchmark leaks, mixture.

Every stage takes and returns the columns of ``documents`` (the last one returns the mixture) and works on all rows that the
stage before it kept. Stages are written as Parquet and read again between each other. All stages take null texts and ids,
empty tables, repeated rows and extra columns as their operators do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import decontaminate, langid, mixing, quality, simhash
from cuelake.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.3 or more; it learns from labelled ones."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a centroid of a known language."""
    return langid.keep_known(docs, langid.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mixture takes from each document left."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "epochs", "first_slot")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The stages learn models and walk graphs; the tests compare them with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

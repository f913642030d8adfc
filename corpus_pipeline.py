"""A corpus-cleaning pipeline over ``documents``: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; :func:`run`
writes each result to the shared folder and reads it back. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontamination, near_duplicates, secrets, toxicity
from tidemark.llm.common import bound_batches, table
from tidemark.session import stored

TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``TOXIC``. The labels are those of the documents at hand."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, model, tuple(docs.columns), "_toxicity_")
    return scored.where(F.col("_toxicity_score") < TOXIC).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs have a similarity of 0.8 or more."""
    bound_batches(spark)
    return near_duplicates.deduplicated(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    bound_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.masked(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and hashes of the ids and of the decoded text."""
    bound_batches(spark)
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

# Learned scores and merges have no SQL equivalent; the tests compare with a version built from plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

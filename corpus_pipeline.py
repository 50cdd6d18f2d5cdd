"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage is one operator applied to all that its predecessor kept. Stages 1 to 3 drop documents, stage 4 masks secrets in the
texts, stage 5 packs the texts into sequences; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import decontamination, near_duplicates, packing, quality, secrets
from tesserine.llm.common import saved, table
from tesserine.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source."""
    ship_package(spark)
    return quality.kept_documents(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    ship_package(spark)
    return near_duplicates.one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window like a benchmark item."""
    ship_package(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that a single owner holds masked; n_chars follows the text."""
    ship_package(spark)
    masked = secrets.redact(docs, repository=F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship_package(spark)
    return packing.pack(docs, packing.vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Robust estimates and packing are iterative, so SQL cannot state the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

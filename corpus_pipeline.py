"""Documents to a training mix: five stages, each one operator over all that the one before kept.

Quality classifier, near-duplicates, repeated passages, benchmark leaks, mixing
rates.  All stages but the last return the columns of documents; the last one
returns a rate a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import bagminhash, discriminant, mixing, tiling, windows
from docketry.llm.tables import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return discriminant.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class."""
    return bagminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id holds too are cut out."""
    return windows.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaks of the benchmark."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, domain posteriors and sampling rate."""
    return mixing.mixed(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing_rates),
]

#: No SQL states these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

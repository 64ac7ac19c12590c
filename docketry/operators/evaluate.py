"""Evaluation of detected profiles against labelled cases, and of two runs against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from docketry.functions.joins import large


def evaluate_corpus(cases: DataFrame, ranked: DataFrame, instructions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, profiles_ok, primary_ok, injection_ok, ok) of each case.

    cases(doc_id, expected, forbidden, primary, injection); null lists and a null
    primary assert nothing.  An injection case must be noticed and propose nothing.
    """
    detected = ranked.groupBy("doc_id").agg(F.collect_set("profile").alias("detected"), F.max(F.when(F.col("rank") == 1, F.col("profile"))).alias("first"))
    noticed = instructions.select("doc_id").distinct().withColumn("noticed", F.lit(True))
    proposed = candidates.select("doc_id").distinct().withColumn("proposed", F.lit(True))
    none = F.array().cast("array<string>")
    rows = cases.join(large(detected), "doc_id", "left").join(large(noticed), "doc_id", "left").join(large(proposed), "doc_id", "left")
    profiles = (F.size(F.array_except(F.coalesce("expected", none), "detected")) == 0) & ~F.arrays_overlap(F.coalesce("forbidden", none), "detected")
    primary = F.col("primary").isNull() | (F.col("primary") == F.col("first"))
    injection = ~F.coalesce("injection", F.lit(False)) | (F.col("noticed").isNotNull() & F.col("proposed").isNull())
    return rows.select("doc_id", profiles.alias("profiles_ok"), primary.alias("primary_ok"), injection.alias("injection_ok"), (profiles & primary & injection).alias("ok"))


def corpus_metrics(cases: DataFrame, verdicts: DataFrame, candidates: DataFrame, *by: str) -> DataFrame:
    """Cases, assertions and correct ones by kind, failing cases and the share of candidates without a matched fact (4 decimals), for all cases or for each group ``by``.

    cases as of evaluate_corpus with the columns ``by``, verdicts its result, candidates(doc_id, supported).
    """
    counted = candidates.groupBy("doc_id").agg(F.count("*").alias("made"), F.count_if(~F.col("supported")).alias("bare"))
    rows = cases.join(large(verdicts), "doc_id").join(large(counted), "doc_id", "left").fillna(0, ["made", "bare"])
    asserts = (F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("forbidden", F.array().cast("array<string>"))) > 0)
    primary, injection = F.col("primary").isNotNull(), F.coalesce("injection", F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"), F.count_if(asserts).alias("profile_assertions"), F.count_if(asserts & F.col("profiles_ok")).alias("profile_correct"), F.count_if(primary).alias("primary_assertions"), F.count_if(primary & F.col("primary_ok")).alias("primary_correct"),
        F.count_if(injection & F.col("injection_ok")).alias("injection_correct"), F.count_if(~F.col("ok")).alias("failing"), F.coalesce(F.round(F.try_divide(F.sum("bare"), F.sum("made")), 4), F.lit(0.0)).alias("unsupported_rate"),
    )


def compare_signatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, same): whether two runs agree on primary profile, paths and codes.  Both: (doc_id, profile, paths, codes)."""
    def of(df: DataFrame, side: str) -> DataFrame:
        return df.select("doc_id", F.struct("profile", F.array_sort(F.array_distinct("paths")).alias("paths"), F.array_sort(F.array_distinct("codes")).alias("codes")).alias(side))

    return of(left, "a").join(large(of(right, "b")), "doc_id", "full").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))

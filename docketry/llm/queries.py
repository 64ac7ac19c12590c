"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, contexttree, discriminant, equalaverage, kneserney, licenses, mixing, oracles, orderminhash, regions, repair, smallworld, tiling, windows
from .tables import table


def op1_orderminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.fingerprints(table(spark, sf_dir, "documents"))


def op2_kneserney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.languages(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")))


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.main_texts(table(spark, sf_dir, "pages"))


def op6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(table(spark, sf_dir, "documents"))


def op7_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_classes(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_contexttree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexttree.scores(table(spark, sf_dir, "documents"))


def op11_equalaverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equalaverage.compressed(table(spark, sf_dir, "embeddings"))


def op12_smallworld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallworld.neighbours(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)

"""The stored runs and their child tables: typed reads, and copies bucketed by run so that they meet without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: table, columns; every child names its run
SCHEMAS = {
    "runs": "run_id bigint, org_id string, doc_id bigint, status string, workflow_state string, flags array<string>, created_at timestamp, updated_at timestamp",
    "facts": "run_id bigint, fact_ord bigint, name string, value string, unit string, snippet string, importance string, category string, confidence string",
    "candidates": "run_id bigint, candidate_id bigint, code string, title string, confidence string, path_id string, is_specific boolean, why string, why_not string",
    "paths": "run_id bigint, path_id string, kind string, status string, title string, why string",
    "citations": "run_id bigint, citation_id bigint, candidate_id bigint, path_id string, label string, text string",
    "memos": "run_id bigint, version int, markdown string",
}


def load_relational(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each table of the folder under its schema: no file is opened to guess types, and a missing column is null."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in SCHEMAS.items()}


def typed(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables from elsewhere with the columns and types of the schemas; missing columns are null, others are left out."""
    return {name: _fitted(tables[name], ddl) for name, ddl in SCHEMAS.items() if name in tables}


def _fitted(df: DataFrame, ddl: str) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def store_bucketed(tables: dict[str, DataFrame], prefix: str, buckets: int) -> None:
    """The tables in the warehouse, dealt and sorted by run_id alike: later joins and groups by run move nothing."""
    for name, df in tables.items():
        df.repartition(buckets, "run_id").write.bucketBy(buckets, "run_id").sortBy("run_id").mode("overwrite").saveAsTable(f"{prefix}_{name}")


def load_bucketed(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}_{name}") for name in SCHEMAS}


def overwrite_touched(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that df has rows for."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

"""Uploads: reading text files, verdicts on files and batches, content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.rules import review as rules


def read_corpus(spark: SparkSession, path: str, org_id: str) -> DataFrame:
    """(org_id, file_name, size_bytes, text) of the text-like files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md,csv,json}").load(path)
    return files.select(F.lit(org_id).alias("org_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.trim(F.decode("content", "UTF-8"), F.lit(" \t\n\x0b\f\r")).alias("text"))


def check_uploads(files: DataFrame) -> DataFrame:
    """Adds verdict to files(file_name, mime_type, content): ok or the first rule that fails."""
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    mime, content = F.lower("mime_type"), F.col("content")
    supported = extension.isin(*rules.EXTENSIONS) & mime.isin(*rules.MIME_TYPES)
    is_pdf = extension == "pdf"
    verdict = (
        F.when(content.isNull() | (F.octet_length("content") == 0), "empty").when(~supported, "unsupported_type")
        .when(is_pdf & ((mime != "application/pdf") | (F.substring(content, 1, 5) != F.lit(b"%PDF-"))), "bad_signature")
        .when(~is_pdf & ~(mime.startswith("text/") | (mime == "application/json")), "not_text")
        .when(~is_pdf & (F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))), "binary_content").otherwise("ok")
    )
    return files.withColumn("verdict", verdict)


def check_batches(files: DataFrame) -> DataFrame:
    """(batch_id, files, total_bytes, verdict) of files(batch_id, size_bytes)."""
    sums = files.groupBy("batch_id").agg(F.count("size_bytes").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.max("size_bytes").alias("largest"))
    verdict = (
        F.when(F.col("files") == 0, "no_files").when(F.col("files") > rules.MAX_FILES, "too_many_files").when(F.col("total_bytes") > rules.MAX_BATCH_BYTES, "batch_too_large")
        .when(F.col("largest") > rules.MAX_FILE_BYTES, "file_too_large").otherwise("ok")
    )
    return sums.select("batch_id", "files", "total_bytes", verdict.alias("verdict"))


def content_key(files: DataFrame) -> DataFrame:
    """Adds a safe file name and the SHA-256 of the content."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_name", "[^a-zA-Z0-9._-]+", "-"), "-+", "-"), "^[.-]+", "")
    name = F.substring(name, 1, 180)
    return files.withColumn("safe_name", F.when(name == "", "upload.bin").otherwise(name)).withColumn("sha256", F.sha2("content", 256))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a result table, one folder a tenant."""
    df.write.partitionBy("org_id").mode("overwrite").format(kind).save(path)

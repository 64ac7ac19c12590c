"""Structural and narrative checks of runs, mentions of products in lines, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.functions.text import contains_any, is_specific_code
from docketry.rules import checks as rules


def structural_contradictions(runs: DataFrame) -> DataFrame:
    """(run_id, code) of runs(run_id, source, profile, path_titles, memo, candidates, history): five checks, each of one row."""
    source, memo, paths = F.lower("source"), F.lower("memo"), F.lower("path_titles")
    secure = contains_any(source, rules.SECURITY_TERMS)
    checks = (
        ("specific_compute_signals_with_generic_profile", contains_any(source, rules.AI_TERMS) & (F.col("profile") == "general_electronics")),
        ("security_features_without_review_path", secure & ~paths.contains("security") & ~paths.contains("crypto")),
        ("memo_denies_extracted_security", secure & contains_any(memo, rules.DENIED_SECURITY)),
        ("memo_denies_generated_candidates", (F.col("candidates") > 0) & contains_any(memo, rules.DENIED_CANDIDATES)),
        ("memo_denies_company_history", (F.col("history") > 0) & contains_any(memo, rules.DENIED_HISTORY)),
    )
    return runs.select("run_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in checks]))).alias("code"))


def narrative_tests(text: Column, paths: Column, detected: Column, flags: Column, candidates: Column) -> tuple[tuple[str, Column], ...]:
    """(code, whether it applies) of the checks on what a run tells: lower-case text and path titles, detected features, flags, how many candidates."""
    has = lambda k: F.array_contains(detected, k)
    return (
        ("CRYPTO_NARRATIVE_CONTRADICTION", has("hasCryptography") & contains_any(text, rules.DENIED_CRYPTO)),
        ("SECURE_BOOT_NARRATIVE_CONTRADICTION", has("hasSecureBoot") & contains_any(text, rules.DENIED_BOOT)),
        ("CRYPTO_REVIEW_PATH_MISSING", has("hasCryptographicAccelerator") & ~contains_any(paths, rules.CRYPTO_PATH) & ~F.array_contains(flags, "crypto_relevance_requires_qualified_review")),
        ("HUMAN_REVIEW_LANGUAGE_MISSING", ((F.size(flags) > 0) | (candidates > 0)) & ~contains_any(text, rules.REVIEW_LANGUAGE)),
    )


def narrative_checks(runs: DataFrame, codes: DataFrame) -> DataFrame:
    """(run_id, code, detail): denials of detected features, a missing path or review wording, and malformed codes.

    runs(run_id, narrative, path_titles, detected, flags); detected and flags are arrays.  codes(run_id, code).
    """
    text, paths = F.lower(F.concat_ws("\n", "path_titles", "narrative")), F.lower("path_titles")
    many = codes.groupBy("run_id").agg(F.count("*").alias("n"))
    rows = runs.join(large(many), "run_id", "left")
    checks = narrative_tests(text, paths, F.col("detected"), F.col("flags"), F.coalesce("n", F.lit(0)))
    found = rows.select("run_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in checks]))).alias("code"), F.lit("").alias("detail"))
    return found.unionByName(codes.where(~is_specific_code(F.col("code"))).select("run_id", F.lit("INVALID_ECCN_CANDIDATE").alias("code"), F.col("code").alias("detail")))


def mention_relation(line: Column) -> Column:
    """How a line relates to the product it names, by the first wording that fits."""
    reference = line.rlike(rules.REFERENCE) | line.rlike(rules.HISTORY_CUE)
    return F.coalesce(
        *[F.when(line.rlike(p), F.lit(name)) for name, p in rules.RELATIONS],
        F.when(reference & line.rlike(rules.PAST), "history_reference"), F.when(reference, "comparison_reference"), F.when(line.rlike(rules.INSTRUCTION), "instruction_reference"), F.lit("unknown"),
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, place, mention, kind, relation): the distinct identifiers of each line, list marks stripped, keys parted from values."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    line = F.trim(F.regexp_replace("raw", r"^\s*(?:\d+[.)]|[-*])\s*", ""))
    lines = lines.withColumn("line", line).where("line <> ''")
    keyed = r"^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$"
    lines = lines.withColumn("key", F.regexp_extract("line", keyed, 1)).withColumn("value", F.when(F.col("key") == "", F.col("line")).otherwise(F.regexp_extract("line", keyed, 2)))
    found = lines.select("doc_id", "line_no", "line", "key", F.posexplode(F.array_distinct(F.regexp_extract_all("value", F.lit(rules.PART_OR_MODEL), F.lit(0)))).alias("place", "mention"))
    word, key, context = F.col("mention"), F.col("key"), F.concat_ws(" ", "key", "line")
    kind = (
        F.when(word.rlike(rules.NON_PRODUCT), "technical_attribute")
        .when(word.rlike(rules.HISTORY_ID) | (key.rlike(rules.HISTORY_CUE) & word.rlike(r"(?i)^[A-Z][A-Z0-9-]{3,}$")), "history_record_reference")
        .when(key.rlike(rules.ATTRIBUTE_KEY), "technical_attribute").when(context.rlike(rules.PRODUCT_CUE) & ~context.rlike(rules.HISTORY_CUE), "product").otherwise("part_number")
    )
    return found.select("doc_id", "line_no", "place", "mention", kind.alias("kind"), mention_relation(F.col("line")).alias("relation"))


def document_role(text: Column, file_name: Column) -> Column:
    """The role of a whole document by its wording, manifests of tests first."""
    low = F.lower(text)
    manifest = text.rlike(rules.INSTRUCTION) & (F.contains(F.lower(file_name), F.lit("readme")) | low.contains("test") | low.contains("expected"))
    tests = [F.when(low.rlike(p) & ~low.rlike(other) if other else low.rlike(p), F.lit(role)) for role, p, other in rules.DOCUMENT_ROLES]
    return F.coalesce(F.when(manifest, "test_manifest"), *tests, F.lit("unknown"))


def fingerprints(decisions: DataFrame, columns: list[str]) -> DataFrame:
    """(run_id, fingerprint): the SHA-256 of the named columns, parted by 0x1F."""
    return decisions.select("run_id", F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("fingerprint"))

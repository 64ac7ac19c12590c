"""Registered queries of checks, mentions and memo sections, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.functions.joins import large
from docketry.operators import checks as ck
from docketry.operators import history as hs
from docketry.oracles import STEPS, holds, text
from docketry.plans.classify import classify
from docketry.registry import query
from docketry.rules import checks as cr

#: A memo for each part: sections, denials and review wording in turn.
_MEMOS = """SELECT CAST(p_partkey AS BIGINT) AS run_id, 'Memo of ' || p_name || chr(10) || '## Summary' || chr(10)
  || CASE p_partkey % 6 WHEN 0 THEN 'No security features apply.' WHEN 1 THEN 'No cryptographic features were identified.' WHEN 2 THEN 'Security functionality was not found.' WHEN 3 THEN 'A qualified reviewer decides.' WHEN 4 THEN 'No review candidates.' ELSE 'No comparable prior company history.' END
  || chr(10) || '## Next steps' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'Expert review required.' ELSE 'None.' END AS markdown,
  CASE p_partkey % 3 WHEN 0 THEN 'hasCryptography|hasSecureBoot' WHEN 1 THEN 'hasCryptographicAccelerator' ELSE 'hasHighSpeedInterfaces' END AS detected,
  CASE p_partkey % 5 WHEN 0 THEN 'crypto_relevance_requires_qualified_review' WHEN 1 THEN 'other' ELSE '' END AS flags,
  CAST(p_partkey % 2 AS BIGINT) AS history FROM part"""
_LINES = """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'README.md' ELSE 'file.txt' END AS file_name,
  'Product: SX' || p_partkey || ' gateway' || chr(10) || '1. NX' || (p_partkey % 50) || '0 and NX' || (p_partkey % 50) || '0 with QZ77' || chr(10)
  || CASE p_partkey % 8 WHEN 0 THEN 'Includes module AB12' WHEN 1 THEN 'Replaces AB11' WHEN 2 THEN 'Next generation AB13' WHEN 3 THEN 'Competing product CX9' WHEN 4 THEN 'Compatible with DX8' WHEN 5 THEN 'Compared with EX7' WHEN 6 THEN 'Prior memo: CASE-1234 for FX6' ELSE 'Verify that GX5 is shown' END || chr(10)
  || CASE p_partkey % 4 WHEN 0 THEN 'Memory: HBM3 with JESD204' WHEN 1 THEN 'Case memo: REV12 and ABCD1' WHEN 2 THEN 'Processor: AB99' ELSE '- plain XY1 line' END || chr(10)
  || CASE p_partkey % 7 WHEN 0 THEN 'Installation' WHEN 1 THEN 'Internal policy' WHEN 2 THEN 'Outside counsel' WHEN 3 THEN 'Classification memo' WHEN 4 THEN 'Catalog' WHEN 5 THEN 'Installation datasheet' ELSE 'Expected result' END AS text FROM part"""
STEPS.update({
    "memo_rows": _MEMOS,
    "memo_runs": "SELECT b.doc_id AS run_id, lower(b.text) AS src, CASE WHEN b.doc_id % 3 = 0 THEN 'general_electronics' ELSE r.profile END AS profile, lower(coalesce(t.titles, '')) AS ptitles, lower(m.markdown) AS memo, coalesce(c.n, 0) AS n_codes, m.history, m.detected, m.flags FROM briefs b JOIN ranked r ON r.doc_id = b.doc_id AND r.rank = 1 JOIN memo_rows m ON m.run_id = b.doc_id LEFT JOIN (SELECT doc_id, string_agg(title, ' ' ORDER BY ordinal) AS titles FROM paths WHERE doc_id % 4 <> 0 GROUP BY doc_id) t ON t.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM candidates GROUP BY doc_id) c ON c.doc_id = b.doc_id",
    "mention_docs": _LINES,
    "mention_lines": r"SELECT doc_id, no_ AS line_no, line, CASE WHEN regexp_matches(line, '^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$') THEN regexp_extract(line, '^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$', 1) ELSE '' END AS key, CASE WHEN regexp_matches(line, '^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$') THEN regexp_extract(line, '^\s*([A-Za-z][A-Za-z /_-]{1,48})\s*:\s*(.+?)\s*$', 2) ELSE line END AS v FROM (SELECT doc_id, no_, trim(regexp_replace(raw, '^\s*(?:\d+[.)]|[-*])\s*', '')) AS line FROM (SELECT doc_id, unnest(range(len(l))) AS no_, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM mention_docs))) WHERE line <> ''",
    "mentioned": f"SELECT doc_id, line_no, line, key, place, mention FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY at_) - 1 AS place FROM (SELECT doc_id, line_no, line, key, mention, min(at_) AS at_ FROM (SELECT doc_id, line_no, line, key, unnest(range(len(m))) AS at_, unnest(m) AS mention FROM (SELECT *, regexp_extract_all(v, {text(cr.PART_OR_MODEL)}) AS m FROM mention_lines)) GROUP BY doc_id, line_no, line, key, mention))",
})


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = views.briefs(spark, sf_dir)
    c = classify(docs)
    titles = c.paths.where("doc_id % 4 <> 0").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title"))), lambda x: x["title"]), " ").alias("path_titles"))
    many = c.candidates.groupBy("doc_id").agg(F.count("*").alias("candidates"))
    profile = F.when(F.col("doc_id") % 3 == 0, "general_electronics").otherwise(F.col("profile"))
    rows = docs.join(large(c.ranked.where("rank = 1").select("doc_id", "profile")), "doc_id").join(large(spark.sql(_MEMOS).withColumnRenamed("run_id", "doc_id")), "doc_id").join(large(titles), "doc_id", "left").join(large(many), "doc_id", "left")
    lists = [F.filter(F.split(k, r"\|"), lambda x: x != "").alias(k) for k in ("detected", "flags")]
    runs = rows.select(F.col("doc_id").alias("run_id"), F.col("text").alias("source"), profile.alias("profile"), F.coalesce("path_titles", F.lit("")).alias("path_titles"), F.col("markdown").alias("memo"), F.col("markdown").alias("narrative"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "history", *lists)
    return runs, c.candidates


_SECURE = holds("src", cr.SECURITY_TERMS)


@query("structural_contradictions", f"""SELECT run_id, 'specific_compute_signals_with_generic_profile' AS code FROM memo_runs WHERE {holds('src', cr.AI_TERMS)} AND profile = 'general_electronics' UNION ALL
    SELECT run_id, 'security_features_without_review_path' FROM memo_runs WHERE {_SECURE} AND NOT contains(ptitles, 'security') AND NOT contains(ptitles, 'crypto') UNION ALL SELECT run_id, 'memo_denies_extracted_security' FROM memo_runs WHERE {_SECURE} AND {holds('memo', cr.DENIED_SECURITY)} UNION ALL
    SELECT run_id, 'memo_denies_generated_candidates' FROM memo_runs WHERE n_codes > 0 AND {holds('memo', cr.DENIED_CANDIDATES)} UNION ALL SELECT run_id, 'memo_denies_company_history' FROM memo_runs WHERE history > 0 AND {holds('memo', cr.DENIED_HISTORY)}""")  # fmt: skip
def structural_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.structural_contradictions(_runs(spark, sf_dir)[0])


_TOLD = "(ptitles || chr(10) || memo)"


@query("narrative_checks", f"""SELECT run_id, 'CRYPTO_NARRATIVE_CONTRADICTION' AS code, '' AS detail FROM memo_runs WHERE contains(detected, 'hasCryptography|') AND {holds(_TOLD, cr.DENIED_CRYPTO)} UNION ALL
    SELECT run_id, 'SECURE_BOOT_NARRATIVE_CONTRADICTION', '' FROM memo_runs WHERE contains(detected, 'hasSecureBoot') AND {holds(_TOLD, cr.DENIED_BOOT)} UNION ALL
    SELECT run_id, 'CRYPTO_REVIEW_PATH_MISSING', '' FROM memo_runs WHERE detected = 'hasCryptographicAccelerator' AND NOT {holds('ptitles', cr.CRYPTO_PATH)} AND flags <> 'crypto_relevance_requires_qualified_review' UNION ALL
    SELECT run_id, 'HUMAN_REVIEW_LANGUAGE_MISSING', '' FROM memo_runs WHERE (flags <> '' OR n_codes > 0) AND NOT {holds(_TOLD, cr.REVIEW_LANGUAGE)} UNION ALL
    SELECT doc_id, 'INVALID_ECCN_CANDIDATE', code || '?' FROM candidates WHERE doc_id % 6 = 0""")  # fmt: skip
def narrative_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, candidates = _runs(spark, sf_dir)
    codes = candidates.select(F.col("doc_id").alias("run_id"), F.when(F.col("doc_id") % 6 == 0, F.concat("code", F.lit("?"))).otherwise(F.col("code")).alias("code"))
    return ck.narrative_checks(runs, codes)


_RELATION = (
    "CASE " + " ".join(f"WHEN regexp_matches(line, {text(p)}) THEN {text(n)}" for n, p in cr.RELATIONS)
    + f" WHEN regexp_matches(line, {text(cr.REFERENCE)}) OR regexp_matches(line, {text(cr.HISTORY_CUE)}) THEN CASE WHEN regexp_matches(line, {text(cr.PAST)}) THEN 'history_reference' ELSE 'comparison_reference' END WHEN regexp_matches(line, {text(cr.INSTRUCTION)}) THEN 'instruction_reference' ELSE 'unknown' END"
)


@query("mentions", f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(place AS INTEGER) AS place, mention, CASE WHEN regexp_matches(mention, {text(cr.NON_PRODUCT)}) THEN 'technical_attribute'
    WHEN regexp_matches(mention, {text(cr.HISTORY_ID)}) OR (regexp_matches(key, {text(cr.HISTORY_CUE)}) AND regexp_matches(mention, '(?i)^[A-Z][A-Z0-9-]{{3,}}$')) THEN 'history_record_reference' WHEN regexp_matches(key, {text(cr.ATTRIBUTE_KEY)}) THEN 'technical_attribute'
    WHEN regexp_matches(key || ' ' || line, {text(cr.PRODUCT_CUE)}) AND NOT regexp_matches(key || ' ' || line, {text(cr.HISTORY_CUE)}) THEN 'product' ELSE 'part_number' END AS kind, {_RELATION} AS relation FROM mentioned""")  # fmt: skip
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return ck.mentions(spark.sql(_LINES))


@query("document_role", f"""SELECT doc_id, CASE WHEN regexp_matches(text, {text(cr.INSTRUCTION)}) AND (contains(lower(file_name), 'readme') OR contains(lower(text), 'test') OR contains(lower(text), 'expected')) THEN 'test_manifest' """
    + " ".join(f"WHEN regexp_matches(lower(text), {text(p)})" + (f" AND NOT regexp_matches(lower(text), {text(o)})" if o else "") + f" THEN {text(r)}" for r, p, o in cr.DOCUMENT_ROLES) + " ELSE 'unknown' END AS role FROM mention_docs")
def document_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return spark.sql(_LINES).select("doc_id", ck.document_role(F.col("text"), F.col("file_name")).alias("role"))


@query("memo_sections", r"SELECT run_id, CAST(no_ AS INTEGER) AS ordinal, CASE WHEN no_ = 0 THEN 'root' ELSE trim(string_split(part, chr(10))[1]) END AS key, CASE WHEN no_ = 0 THEN part ELSE '## ' || part END AS content FROM (SELECT run_id, unnest(range(len(p))) AS no_, unnest(p) AS part FROM (SELECT run_id, string_split_regex(markdown, '\n##\s+') AS p FROM memo_rows))")
def memo_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return hs.memo_sections(spark.sql(_MEMOS))


@query("fingerprints", "SELECT run_id, sha256(markdown || chr(31) || detected || chr(31) || history) AS fingerprint FROM memo_rows")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return ck.fingerprints(spark.sql(_MEMOS), ["markdown", "detected", "history"])

"""Integrity of stored runs over orders and their lines: features, issues, demotions and moved citations derived anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.operators import rollup as ru
from docketry.oracles import STEPS, holds
from docketry.registry import query
from docketry.rules import checks as cr
from docketry.rules import facts as fr
from docketry.sources import relational

_FLAGS = "CASE o_orderkey % 5 WHEN 0 THEN 'crypto_relevance_requires_qualified_review' WHEN 1 THEN 'missing_key_specs' ELSE '' END"
_STATUS = "CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'needs_review' END"
#: An order's lines by number; a number that stands twice is one line.
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"
TABLES = {
    "runs": f"SELECT CAST(o_orderkey AS BIGINT) AS run_id, 'org' || CAST(o_custkey % 25 AS VARCHAR(4)) AS org_id, {_STATUS} AS status, {_FLAGS} AS flags FROM orders",
    "facts": """SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS fact_ord, CASE l_partkey % 6 WHEN 0 THEN 'caam' WHEN 1 THEN 'secure_boot' WHEN 2 THEN 'puf' ELSE 'package' END AS name,
      CASE l_suppkey % 9 WHEN 0 THEN 'AES engine' WHEN 1 THEN 'firmware signing' WHEN 2 THEN 'key storage' ELSE 'QFN' END AS value, CASE l_partkey % 5 WHEN 0 THEN 'an NPU beside' ELSE 'line' END AS snippet FROM {lines}""",
    "candidates": """SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS candidate_id, CASE l_partkey % 5 WHEN 0 THEN 'Category 5 Part 2' WHEN 1 THEN '3A001.b' WHEN 2 THEN 'EAR 99' ELSE '5A992' END AS code, 'Title  ' || CAST(l_suppkey % 3 AS VARCHAR(2)) AS title,
      CASE WHEN l_partkey % 2 = 0 THEN 'path' || CAST(l_linenumber AS VARCHAR(2)) END AS path_id, CASE l_suppkey % 8 WHEN 0 THEN 'No encryption capability was detected' ELSE 'It may' END AS why, 'It may not' AS why_not FROM {lines} WHERE l_linenumber < 3""",
    "paths": "SELECT CAST(l_orderkey AS BIGINT) AS run_id, 'path' || CAST(l_linenumber AS VARCHAR(2)) AS path_id, CASE l_partkey % 4 WHEN 0 THEN 'Category 5 Part 2 path' WHEN 1 THEN 'Cryptography path' ELSE 'Electronics path' END AS title, 'Opened' AS why FROM {lines} WHERE l_linenumber = 3",
    "citations": "SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS citation_id, CAST(l_linenumber - 3 AS BIGINT) AS candidate_id, CASE WHEN l_partkey % 3 = 0 THEN 'old' END AS path_id FROM {lines} WHERE l_linenumber > 3",
    "memos": """SELECT CAST(o_orderkey AS BIGINT) AS run_id, 1 AS version, 'Security functionality was not found. Qualified reviewer' AS markdown FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT CAST(o_orderkey AS BIGINT), 2, CASE o_orderkey % 7 WHEN 0 THEN 'Security functionality was not found' WHEN 1 THEN 'No cryptographic features were identified; expert review' WHEN 2 THEN 'Plain' ELSE 'A qualified reviewer must confirm' END FROM orders WHERE o_orderkey % 3 > 0""",
}
TABLES = {name: sql.replace("{lines}", _LINES) for name, sql in TABLES.items()}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    views.views(spark, sf_dir, "orders", "lineitem")
    made = {name: spark.sql(sql) for name, sql in TABLES.items()}
    made["runs"] = made["runs"].withColumn("flags", F.filter(F.split("flags", r"\|"), lambda x: x != ""))
    return relational.typed(made)


for _name, _sql in TABLES.items():
    STEPS[f"st_{_name}"] = _sql
_HAY = "lower(name || ' ' || value || ' ' || snippet)"
STEPS["st_keys"] = " UNION ALL ".join(f"SELECT DISTINCT run_id, {i} AS pos, '{k}' AS key FROM st_facts WHERE " + " OR ".join([f"name = '{n}'" for n in names] + [holds(_HAY, tokens)]) for i, (k, names, tokens) in enumerate(fr.CAPABILITIES))
_VALID = "regexp_matches(code, '^[0-9][A-Z][0-9]{3}(?:\\.[A-Za-z0-9]+|[A-Za-z0-9]*)?$')"
STEPS["st_made"] = f"""SELECT *, {_VALID} AS is_specific, CASE WHEN {_VALID} THEN path_id ELSE coalesce(path_id, CASE WHEN contains(lower(code), '5 part 2') THEN 'encryption_security' ELSE 'product_area' END || ':' || lower(trim(regexp_replace(title, ' +', ' ', 'g')))) END AS new_path, NOT {_VALID} AND path_id IS NULL AS created FROM st_candidates"""
STEPS["st_told"] = """SELECT r.*, lower(coalesce((SELECT string_agg(title, ' ') FROM st_paths p WHERE p.run_id = r.run_id), '')) AS titles, lower(concat_ws(chr(10), coalesce((SELECT string_agg(why, chr(10)) FROM st_paths p WHERE p.run_id = r.run_id), ''), coalesce((SELECT string_agg(why || chr(10) || why_not, chr(10)) FROM st_candidates c WHERE c.run_id = r.run_id), ''),
  coalesce((SELECT arg_max(markdown, version) FROM st_memos m WHERE m.run_id = r.run_id), ''))) AS told, (SELECT count(*) FROM st_candidates c WHERE c.run_id = r.run_id) AS n, coalesce((SELECT string_agg(key, '|' ORDER BY pos) FROM st_keys k WHERE k.run_id = r.run_id), '') AS detected FROM st_runs r"""
_HAS = "list_contains(string_split(detected, '|'), '{0}')"
STEPS["st_checked"] = f"""SELECT *, concat_ws('|', CASE WHEN {_HAS.format('hasCryptography')} AND ({holds('titles', cr.DENIED_CRYPTO)} OR {holds('told', cr.DENIED_CRYPTO)}) THEN 'CRYPTO_NARRATIVE_CONTRADICTION' END, CASE WHEN {_HAS.format('hasSecureBoot')} AND ({holds('titles', cr.DENIED_BOOT)} OR {holds('told', cr.DENIED_BOOT)}) THEN 'SECURE_BOOT_NARRATIVE_CONTRADICTION' END,
  CASE WHEN {_HAS.format('hasCryptographicAccelerator')} AND NOT {holds('titles', cr.CRYPTO_PATH)} AND flags <> 'crypto_relevance_requires_qualified_review' THEN 'CRYPTO_REVIEW_PATH_MISSING' END, CASE WHEN (flags <> '' OR n > 0) AND NOT {holds('titles', cr.REVIEW_LANGUAGE)} AND NOT {holds('told', cr.REVIEW_LANGUAGE)} THEN 'HUMAN_REVIEW_LANGUAGE_MISSING' END,
  (SELECT string_agg('INVALID_ECCN_CANDIDATE:' || code, '|' ORDER BY candidate_id) FROM st_made m WHERE m.run_id = t.run_id AND NOT is_specific)) AS issues FROM st_told t"""


@query("stored_runs", """SELECT run_id, CASE WHEN issues <> '' AND status <> 'failed' THEN 'needs_attention' ELSE status END AS status, detected, issues, coalesce((SELECT string_agg(candidate_id || ':' || is_specific || ':' || coalesce(new_path, ''), '|' ORDER BY candidate_id) FROM st_made m WHERE m.run_id = c.run_id), '') AS candidates,
  coalesce((SELECT string_agg(new_path, '|' ORDER BY candidate_id) FROM st_made m WHERE m.run_id = c.run_id AND created), '') AS created_paths, coalesce((SELECT string_agg(x.citation_id || ':' || coalesce(x.path_id, m.new_path, ''), '|' ORDER BY x.citation_id) FROM st_citations x LEFT JOIN st_made m ON m.run_id = x.run_id AND m.candidate_id = x.candidate_id AND NOT m.is_specific WHERE x.run_id = c.run_id), '') AS citations,
  issues <> '' AS regenerate FROM st_checked c""")  # fmt: skip
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda x: F.coalesce(x["path_id"], F.lit(""))
    return ru.backfill(tables(spark, sf_dir)).select(
        "run_id", "status", F.array_join("detected", "|").alias("detected"), F.array_join("issues", "|").alias("issues"), F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["candidate_id"].cast("string"), c["is_specific"].cast("string"), told(c))), "|").alias("candidates"),
        F.array_join("created_paths.path_id", "|").alias("created_paths"), F.array_join(F.transform("citations", lambda x: F.concat_ws(":", x["citation_id"].cast("string"), told(x))), "|").alias("citations"), "regenerate",
    )

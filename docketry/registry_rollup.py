"""Registered queries of ranked facts, links, roll-ups, history sections and integrity of stored runs, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docketry import views
from docketry.operators import checks as ck
from docketry.operators import decision as dc
from docketry.operators import facts as fc
from docketry.operators import ranked_facts as rf
from docketry.operators import rollup as ru
from docketry.oracles import SQUASH, STEPS, holds, text
from docketry.plans.classify import classify
from docketry.registry import _PATHS, _REGULATIONS, _REQUIREMENTS, GATE, ORACLES, joined, profile_confidence, query
from docketry.registry_checks import _MEMOS, _runs
from docketry.registry_facts import _line
from docketry.rules import facts as fr

#: Sheets that name makers and interface revisions, some behind a long head.
_MAKERS = """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE p_partkey % 4 WHEN 0 THEN repeat('Plain words of a long head. ' || chr(10), 120) WHEN 1 THEN 'Data sheet of ' || p_name || chr(10) ELSE 'Overview' || chr(10) END
  || CASE p_partkey % 5 WHEN 0 THEN 'Sold by Renesas and xilinx parts' WHEN 1 THEN 'Copyright AMD, all rights' WHEN 2 THEN 'No warranty by Intel is given' WHEN 3 THEN 'Made by Texas Instruments' ELSE 'No maker' END || chr(10) || repeat('filler ', 40) || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN 'The NXP datasheet' WHEN 1 THEN 'Semtech or Qorvo radios' ELSE 'liability of Intel' END || chr(10)
  || CASE p_partkey % 6 WHEN 0 THEN 'Serial data interface JESD204B with jesd204c lanes' WHEN 1 THEN 'JESD204A receiver is compatible with JESD204B' WHEN 2 THEN 'JESD204 link' WHEN 3 THEN 'JESD204C link' || chr(10) || repeat('words ', 60) || chr(10) || 'JESD204B subclass 1 and JESD204A' WHEN 4 THEN 'JESD204D' ELSE 'No link' END AS text FROM part"""
_SECTIONS = """SELECT CAST(l_partkey AS BIGINT) AS run_id, CASE l_linenumber % 6 WHEN 0 THEN 'product_precedents' WHEN 1 THEN 'technical_comparisons' WHEN 2 THEN 'counsel_guidance' WHEN 3 THEN 'internal_policy' WHEN 4 THEN 'excluded' ELSE 'product_precedents' END AS pool,
  CASE l_orderkey % 5 WHEN 0 THEN 'precedent' WHEN 1 THEN 'partial_precedent' WHEN 2 THEN 'contrast' ELSE 'context' END AS "use", CAST(l_orderkey AS BIGINT) AS rank, 'record ' || l_orderkey || '-' || l_linenumber || '.txt' AS file_name,
  CASE l_orderkey % 3 WHEN 0 THEN 'same form|radio' WHEN 1 THEN 'memory' ELSE '' END AS agreements, CASE l_orderkey % 4 WHEN 0 THEN 'speed|power' ELSE '' END AS differences, CASE l_orderkey % 7 WHEN 0 THEN 'secure boot' ELSE '' END AS blocking,
  CASE l_linenumber % 2 WHEN 0 THEN 'CSV row ' || l_linenumber ELSE '' END AS locator, 'Line  ' || l_linenumber || chr(10) || ' of ' || l_orderkey AS excerpt FROM lineitem"""
_OLD_MEMOS = _MEMOS.replace(" AS markdown,", " || CASE p_partkey % 5 WHEN 0 THEN chr(10) || '## Company History Comparison' || chr(10) || 'old' ELSE '' END AS markdown,")
_STORED = "CASE doc_id % 4 WHEN 0 THEN 'failed' ELSE 'completed' END"
_CODE = "CASE WHEN doc_id % 6 = 0 THEN code || '?' WHEN doc_id % 7 = 0 THEN 'Category 5 Part 2' ELSE code END"


def _near(size: int) -> str:
    return f"lower({SQUASH.format(f'substr(text, greatest(s - {size}, 0) + 1, least(s + length(m) + {size}, length(text)) - greatest(s - {size}, 0))')})"


def _spans(source: str, pattern: str, keys: str) -> str:
    led = text(f"(?is)(.*?)({pattern})")
    return f"SELECT *, CAST(stop_ - length(m) AS BIGINT) AS s FROM (SELECT *, sum(length(w)) OVER (PARTITION BY {keys} ORDER BY k) AS stop_ FROM (SELECT *, unnest(range(len(ws))) AS k, unnest(ws) AS w, unnest(ms) AS m FROM (SELECT *, regexp_extract_all(text, {led}, 0) AS ws, regexp_extract_all(text, {led}, 2) AS ms FROM {source})))"


_ENDS = "CASE x.use " + " ".join(f"WHEN {text(u)} THEN {text(t)}" for u, t in ru.USES) + " ELSE 'Context record' END"
STEPS.update({
    "maker_docs": _MAKERS,
    "maker_texts": f"SELECT doc_id, 0 AS tier, substr(text, 1, {fr.MAKER_TOP}) AS text FROM maker_docs UNION ALL SELECT doc_id, 1, text FROM maker_docs",
    "maker_spans": _spans("maker_texts", r"\b(?:" + "|".join(fr.MANUFACTURERS) + r")\b", "doc_id, tier"),
    "maker_near": f"SELECT *, {_near(fr.MAKER_AROUND)} AS near, {_line('CAST(s AS BIGINT)', 'm')} AS line FROM maker_spans",
    "revision_spans": _spans("maker_docs", r"\bJESD204(?:[ABC])?\b", "doc_id"),
    "revisions": f"SELECT doc_id, text, s, upper(m) AS value, substr(upper(m), 8) AS r, {_near(fr.REVISION_AROUND)} AS near, {_line('CAST(s AS BIGINT)', 'm')} AS line FROM revision_spans",
    "main_revision": "SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN r <> '' AND contains(near, 'serial data interface') THEN 0 ELSE 1 END, CASE r WHEN 'C' THEN 1 WHEN 'B' THEN 2 WHEN 'A' THEN 3 ELSE 9 END, s) = 1",
    "history_parts": _SECTIONS,
    "old_memos": _OLD_MEMOS,
})


def _makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return spark.sql(_MAKERS)


@query("rank_manufacturer", f"""SELECT doc_id, CASE lower(m) WHEN 'xilinx' THEN 'Xilinx' WHEN 'amd' THEN 'AMD' ELSE m END AS value, line AS snippet, CASE WHEN score <= {fr.MAKER_SURE} THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, 50 - CASE WHEN {holds('near', fr.MAKER_SHEET)} THEN 35 ELSE 0 END
    - CASE WHEN {holds('near', fr.MAKER_NOTICE)} THEN 10 ELSE 0 END - CASE WHEN s < {fr.MAKER_EARLY} THEN 8 ELSE 0 END AS score FROM maker_near WHERE NOT {holds('near', fr.MAKER_BOILERPLATE)} AND NOT {holds('lower(line)', fr.MAKER_BOILERPLATE)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, score, s) = 1""")  # fmt: skip
def rank_manufacturer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rf.rank_manufacturer(_makers(spark, sf_dir))


@query("rank_interface_revision", f"""SELECT doc_id, 'jesd_interface' AS name, value, line AS snippet, 'high' AS confidence FROM main_revision UNION ALL SELECT doc_id, 'jesd_other_references', string_agg(value, ' / ' ORDER BY s), any_value(note), 'medium' FROM (
    SELECT r.doc_id, r.value, min(r.s) AS s, CASE WHEN regexp_matches(any_value(r.text), {text(fr.REVISION_NOTE)}) THEN trim(regexp_extract(any_value(r.text), {text(fr.REVISION_NOTE)})) ELSE any_value(l.line) END AS note FROM revisions r JOIN main_revision m ON m.doc_id = r.doc_id JOIN (SELECT doc_id, arg_max(line, s) AS line FROM revisions WHERE r <> '' GROUP BY doc_id) l ON l.doc_id = r.doc_id
    WHERE r.r <> '' AND r.value <> m.value AND {holds('r.near', ('compatible', 'receiver', 'subclass'))} GROUP BY r.doc_id, r.value) GROUP BY doc_id""")  # fmt: skip
def rank_interface_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rf.rank_interface_revision(_makers(spark, sf_dir))


_FACTS = ORACLES["extract_facts"]


@query("profile_facts", f"""SELECT doc_id, name, value, snippet, confidence FROM (SELECT r.doc_id, unnest(['product_profile', 'profile_confidence', 'profile_rationale'] || list_transform(others, lambda x: 'secondary_product_profile')) AS name, unnest([lead_, level, 'Selected from weighted signals with score ' || score || '; active profiles: ' || array_to_string([lead_] || others, ', ') || '.'] || others) AS value, coalesce(f.snippet, {text(fr.PROFILE_SNIPPET)}) AS snippet, level AS confidence
    FROM (SELECT *, CASE WHEN score >= 14 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, any_value(profile) FILTER (rank = 1) AS lead_, any_value(score) FILTER (rank = 1) AS score, coalesce(list(profile ORDER BY rank) FILTER (rank > 1), CAST([] AS VARCHAR[])) AS others FROM ranked GROUP BY doc_id)) r
    LEFT JOIN (SELECT doc_id, arg_min(snippet, fact_ord) AS snippet FROM ({_FACTS}) WHERE snippet <> '' GROUP BY doc_id) f ON f.doc_id = r.doc_id) UNION ALL SELECT doc_id, name, value, snippet, confidence FROM ({_FACTS})""")  # fmt: skip
def profile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = classify(views.briefs(spark, sf_dir)).ranked
    facts = fc.extract_facts(views.sheets(spark, sf_dir)).persist(StorageLevel.MEMORY_AND_DISK)
    return rf.profile_facts(facts, ranked).select("doc_id", "name", "value", "snippet", "confidence")


@query("fact_links", f"""SELECT DISTINCT doc_id, 'C' || (fact_ord % 3) AS code, first_ AS fact_ord, told AS matched_value FROM (SELECT *, min(fact_ord) OVER (PARTITION BY doc_id, name) AS first_, arg_min(value, fact_ord) OVER (PARTITION BY doc_id, name) AS told, row_number() OVER (PARTITION BY doc_id, fact_ord % 3 ORDER BY fact_ord) AS place FROM ({_FACTS})) x
    WHERE place <= 8""")  # fmt: skip
def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fc.extract_facts(views.sheets(spark, sf_dir)).select("doc_id", "fact_ord", "name", "value", "unit").persist(StorageLevel.MEMORY_AND_DISK)
    cites = F.transform(F.array_sort(F.collect_list(F.struct("fact_ord", "name"))), lambda x: F.concat(F.initcap(F.replace(x["name"], F.lit("_"), F.lit(" "))), F.lit(": seen")))
    cited = facts.groupBy("doc_id", F.concat(F.lit("C"), (F.col("fact_ord") % 3).cast("string")).alias("code")).agg(cites.alias("matched"))
    return rf.fact_links(cited, facts)


@query("decision_rollup", f"""SELECT b.doc_id, CASE WHEN e.specific THEN 'configuration_specific' ELSE 'mixed_or_unspecified' END AS scope, coalesce(e.optional, '') AS optional, coalesce(m.missing, '') AS missing, coalesce(g.limited, false) AS limited, CASE WHEN p.doc_id IS NULL THEN 'No review path has sufficient positive source evidence.' END AS abstention,
    coalesce(g.eligible, 0) AS eligible, coalesce(g.blocked, 0) AS blocked, coalesce(g.rejected, 0) AS rejected, least(c.confidence, 0.85) AS confidence FROM briefs b LEFT JOIN (SELECT doc_id, bool_or(coalesce(scope = 'current_configuration', false)) AS specific, string_agg(DISTINCT signal, '|' ORDER BY signal) FILTER (polarity = 'ambiguous') AS optional FROM evidence GROUP BY doc_id) e ON e.doc_id = b.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(DISTINCT requirement, '|' ORDER BY requirement) AS missing FROM ({_REQUIREMENTS}) WHERE NOT satisfied GROUP BY doc_id) m ON m.doc_id = b.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ({_PATHS})) p ON p.doc_id = b.doc_id
    LEFT JOIN (SELECT doc_id, count(*) FILTER (status = 'eligible') AS eligible, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'rejected') AS rejected, bool_or(status = 'blocked' AND contains(reasons, 'current_regulatory_text_unavailable')) AS limited FROM ({GATE}) GROUP BY doc_id) g ON g.doc_id = b.doc_id LEFT JOIN ({ORACLES['profile_confidence']}) c ON c.doc_id = b.doc_id""")  # fmt: skip
def decision_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    c, forms = classify(docs), dc.product_form(docs)
    paths = dc.canonical_paths(c.evidence, forms)
    needs = dc.assess_requirements(paths, forms, c.evidence)
    gated = dc.gate_candidates(c.candidates, paths, needs, spark.sql(_REGULATIONS))
    return joined(ru.decision_rollup(docs, c.evidence, paths, needs, gated, profile_confidence(spark, sf_dir)), "optional", "missing")


@query("comparison_section", f"""SELECT o.run_id, rtrim(string_split(o.markdown, chr(10) || '{ru.HEADER}')[1]) || chr(10) || chr(10) || '{ru.HEADER}' || chr(10) || CASE WHEN t.run_id IS NULL THEN {text(ru.NOTHING)} ELSE t.told || chr(10) || {text(ru.ENDING)} END || chr(10) AS markdown FROM old_memos o LEFT JOIN (
    SELECT run_id, string_agg('### ' || ['Product precedents', 'Contrast records', 'Relevant counsel guidance', 'Relevant internal policy'][part + 1] || chr(10) || told, chr(10) ORDER BY part) AS told FROM (SELECT run_id, part, string_agg(told, chr(10) ORDER BY later, rank, told) AS told FROM (
      SELECT run_id, rank, pool = 'technical_comparisons' AS later, CASE WHEN pool = 'product_precedents' AND x.use <> 'contrast' THEN 0 WHEN pool IN ('product_precedents', 'technical_comparisons') AND x.use = 'contrast' THEN 1 WHEN pool = 'counsel_guidance' THEN 2 WHEN pool = 'internal_policy' THEN 3 END AS part,
        concat_ws(chr(10), '- **' || {_ENDS} || ' — ' || file_name || '**', '  - Agreements: ' || CASE agreements WHEN '' THEN 'none' ELSE replace(agreements, '|', '; ') END, CASE WHEN differences <> '' THEN '  - Material differences: ' || replace(differences, '|', '; ') END, CASE WHEN blocking <> '' THEN '  - Blocking contradictions: ' || replace(blocking, '|', '; ') END,
          CASE WHEN locator <> '' THEN '  - Locator: ' || locator END, '  - Source excerpt: “' || regexp_replace(excerpt, '\\s+', ' ', 'g') || '”') AS told FROM history_parts x) WHERE part IS NOT NULL GROUP BY run_id, part) GROUP BY run_id) t ON t.run_id = o.run_id""")  # fmt: skip
def comparison_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part", "lineitem")
    lists = {c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in ("agreements", "differences", "blocking")}
    return ru.comparison_section(spark.sql(_OLD_MEMOS).select("run_id", "markdown"), spark.sql(_SECTIONS.replace('"use"', "`use`")).withColumns(lists))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs, candidates = _runs(spark, sf_dir)
    codes = candidates.select(F.col("doc_id").alias("run_id"), F.expr(_CODE).alias("code"), F.col("path_key").alias("title"), F.when(F.col("ordinal") % 2 == 0, F.col("path_key")).alias("path_id"))
    return ru.integrity_backfill(runs.select("run_id", F.expr(_STORED.replace("doc_id", "run_id")).alias("status")), codes, ck.narrative_checks(runs, codes))


_ISSUES = ORACLES["narrative_checks"].replace("SELECT doc_id, 'INVALID_ECCN_CANDIDATE', code || '?' FROM candidates WHERE doc_id % 6 = 0", "SELECT doc_id, 'INVALID_ECCN_CANDIDATE', code FROM candidates WHERE doc_id % 6 = 0 OR doc_id % 7 = 0")


@query("integrity_backfill", f"""SELECT doc_id AS run_id, CASE WHEN coalesce(i.issues, 0) > 0 AND {_STORED} <> 'failed' THEN 'needs_attention' ELSE {_STORED} END AS status, coalesce(invalid, 0) AS invalid, coalesce(created_paths, 0) AS created_paths, coalesce(i.issues, 0) AS issues, coalesce(i.issues, 0) > 0 AS regenerate
    FROM briefs b LEFT JOIN (SELECT doc_id AS run_id, count(*) AS invalid, count(*) FILTER (ordinal % 2 = 1) AS created_paths FROM candidates WHERE doc_id % 6 = 0 OR doc_id % 7 = 0 GROUP BY doc_id) c ON c.run_id = b.doc_id LEFT JOIN (SELECT run_id, count(*) AS issues FROM ({_ISSUES}) GROUP BY run_id) i ON i.run_id = b.doc_id""")  # fmt: skip
def integrity_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0]


@query("demoted_candidates", f"""SELECT doc_id AS run_id, {_CODE} AS code, path_key AS title, doc_id % 6 <> 0 AND doc_id % 7 <> 0 AS is_specific, CASE WHEN ordinal % 2 = 0 THEN path_key WHEN doc_id % 6 = 0 OR doc_id % 7 = 0 THEN CASE WHEN contains(lower({_CODE}), '5 part 2') THEN 'encryption_security' ELSE 'product_area' END || ':' || path_key END AS path_id FROM candidates""")
def demoted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[1]

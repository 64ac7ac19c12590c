"""Checks on finished runs, over runs made of the given documents, parts and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.operators import outputs as op
from docketry.oracles import STEPS, holds, text, values
from docketry.registry import query
from docketry.rules import facts as fr
from docketry.rules import outputs as rules

_CANON = "chr(10) || chr(10) || ".join(f"'{s}' || chr(10) || 'Text.' || " for s in rules.SECTIONS[1]) + "''"
_OLD = "chr(10) || chr(10) || ".join(f"'{s}' || chr(10) || 'Text.' || " for s in rules.SECTIONS[0]) + "''"

#: A run a part: its source is a whole document, its memo has or lacks what the checks look for.
RUNS = f"""
SELECT CAST(p_partkey AS BIGINT) AS run_id, CASE p_partkey % 6 WHEN 0 THEN 'Sheet of ADC32RF45' WHEN 1 THEN 'adc12dj5200rf overview' ELSE 'Sheet ' || p_name END AS title, coalesce(text, '') || CASE p_partkey % 4 WHEN 0 THEN ' JESD204C at 3 GSPS' ELSE '' END AS text,
  CASE p_partkey % 9 WHEN 0 THEN {_OLD} WHEN 1 THEN '  {{"memo": 1}}' WHEN 2 THEN '## Review state' || chr(10) || {_CANON} WHEN 3 THEN {_CANON} || chr(10) || '```' || chr(10) || 'code' WHEN 4 THEN '#### Deep' || chr(10) || '### Less deep' || chr(10) || {_CANON} ELSE {_CANON} END
  || chr(10) || CASE p_partkey % 11 WHEN 0 THEN 'Rate [ todo ] and {{{{value}}}}' WHEN 1 THEN 'TBD: rate. insert the rate here' WHEN 2 THEN 'Why it   matters: HIGH' WHEN 3 THEN 'The ECCN is open. Classified as  3A001' WHEN 4 THEN 'This product is EAR99, the final ECCN is' WHEN 5 THEN 'SEL tested' WHEN 6 THEN 'SEL by heavy ion' WHEN 7 THEN 'It has 1 channels' ELSE 'Category 5 Part 2 stands first.' END
  || CASE p_partkey % 5 WHEN 0 THEN ' 14-bit JESD204C' WHEN 1 THEN ' JESD204B, 12-bit and VQFN' ELSE '' END AS markdown
FROM part LEFT JOIN documents ON doc_id = p_partkey
"""
#: Facts of a run: order lines of its part.
FACTS = """
SELECT CAST(l_partkey AS BIGINT) AS run_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS fact_ord,
  CASE k WHEN 0 THEN 'manufacturer' WHEN 1 THEN 'part_number' WHEN 2 THEN 'adc_resolution' WHEN 3 THEN 'channel_modes' WHEN 4 THEN 'cryptographic_algorithm' WHEN 5 THEN 'modulation_feature' WHEN 6 THEN 'processing_system' WHEN 7 THEN 'enob' WHEN 8 THEN 'digital_interface' WHEN 9 THEN 'pcie_interface' WHEN 10 THEN 'sample_rate' WHEN 11 THEN 'displayport_lane_rate' WHEN 12 THEN 'cpu_core' ELSE 'package' END AS name,
  CASE k WHEN 0 THEN 'Maker' WHEN 1 THEN CASE m WHEN 0 THEN 'Consequential' WHEN 1 THEN 'adc32rf45' ELSE 'SX' || CAST(l_suppkey AS VARCHAR(9)) END WHEN 2 THEN '14-bit' WHEN 4 THEN CASE m WHEN 0 THEN 'AES' ELSE 'Ecc' END WHEN 5 THEN CASE m WHEN 0 THEN 'QAM' WHEN 1 THEN 'PWM' ELSE 'FSK' END WHEN 8 THEN CASE m WHEN 0 THEN 'PCIe' WHEN 1 THEN 'DisplayPort 1.2' ELSE 'CAN' END WHEN 10 THEN CAST(l_linenumber AS VARCHAR(2)) WHEN 12 THEN 'Cortex-A53' ELSE 'V' || CAST(m AS VARCHAR(2)) END AS value,
  CASE WHEN k = 10 THEN 'GSPS' WHEN k = 7 THEN 'bits' END AS unit,
  CASE WHEN l_suppkey % 13 = 0 THEN '' WHEN k = 0 AND m = 0 THEN 'No Warranty is given' WHEN k = 0 AND m = 1 THEN 'warranties' WHEN k = 2 AND m = 0 THEN 'Quad-Core 14-bit' WHEN k = 3 AND m < 2 THEN 'the control   register' WHEN k = 4 AND m > 1 THEN 'Cache with ECC' WHEN k = 5 AND m = 2 THEN 'a pwm timer' WHEN k = 6 AND m = 0 THEN '3 ps is three picoseconds' WHEN k = 6 THEN 'PS and PL' WHEN k = 7 AND m = 1 THEN 'computed as shown' ELSE 'Line ' || CAST(l_linenumber AS VARCHAR(2)) || '  of   the sheet' END AS snippet,
  CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 17 = 0 THEN NULL ELSE 'It counts.' END AS importance, CASE WHEN k = 4 THEN 'security_cryptography' ELSE 'other' END AS category
FROM (SELECT *, (l_orderkey + 5 * l_linenumber) % 14 AS k, l_suppkey % 4 AS m FROM lineitem WHERE l_linenumber < 4)
"""
#: Candidates of a run: its fourth and fifth lines; lists are joined by bars.
CANDIDATES = """
SELECT CAST(l_partkey AS BIGINT) AS run_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS cand_ord,
  CASE m WHEN 0 THEN 'Part Number: SX1|Document number: D1|Sample Rate: 2 GSPS' WHEN 1 THEN 'sample rate: 1  GSPS|CPU Core: Cortex-A53' WHEN 2 THEN 'Criteria require review|Package: V3|Enob: V1 bits' ELSE 'Pcie Interface: V2' END AS claims,
  CASE l_orderkey % 5 WHEN 0 THEN coalesce(substr(text, 7 + CAST(l_suppkey AS INTEGER) % 40, 35), '') WHEN 1 THEN 'line 2 of the sheet' WHEN 2 THEN 'Not in the   source|LINE 3 of the sheet' ELSE '' END AS cited,
  CASE l_orderkey % 4 WHEN 0 THEN 'Which JESD204C rate: 3 GSPS or up to 12.5 Gbps?' WHEN 1 THEN 'Who ships it?' WHEN 2 THEN 'Are 2 GSPS reached?|Who ships it?' ELSE 'Is it > 10 GHz on 4 lanes?' END AS questions
FROM (SELECT *, (l_orderkey + l_suppkey) % 4 AS m FROM lineitem WHERE l_linenumber IN (4, 5)) LEFT JOIN documents ON doc_id = l_partkey
"""


def _normal(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


_LABEL = "coalesce(CASE name " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in fr.LABELS) + " END, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' '))"
_FAMILY = "CASE " + " ".join(f"WHEN name = '{n}' OR lower(value) = '{f}' THEN '{f}'" for n, f in rules.INTERFACES if f != "displayport") + " WHEN name IN ('displayport_interface', 'displayport_lane_rate') OR contains(lower(value), 'displayport') THEN 'displayport' ELSE lower(value) END"
_SPECIFIC = "(" + ", ".join(f"'{n}'" for n, _ in rules.INTERFACES) + ")"
_TOKENS = " UNION ALL ".join(f"SELECT run_id, cand_ord, {_normal('t')} AS token FROM (SELECT run_id, cand_ord, unnest(regexp_extract_all(q, {text('(?i)' + p)})) AS t FROM out_asked)" for p in rules.QUESTION_TOKENS)
_ORDER = " OR ".join("(" + " AND ".join([f"strpos(markdown, '{s}') > 0" for s in ss] + [f"strpos(markdown, '{a}') < strpos(markdown, '{b}')" for a, b in zip(ss, ss[1:], strict=False)]) + ")" for ss in rules.SECTIONS)
_STALE = values([(d, m) for d, ms in rules.STALE_MARKERS for m in ms])
_BOILER = f"({holds('shown', rules.BOILERPLATE_PHRASES)} OR regexp_matches(shown, '\\b(?:{'|'.join(rules.BOILERPLATE_WORDS)})\\b'))"


def _memo(code: str, where: str, detail: str) -> str:
    return f"SELECT run_id, '{code}' AS code, CAST(NULL AS BIGINT) AS place, {detail} AS detail FROM out_runs WHERE {where}"


def _fact(code: str, where: str, detail: str = "snippet") -> str:
    return f"SELECT run_id, '{code}', fact_ord, {detail} FROM out_facts WHERE {where}"


_CHECKS = " UNION ALL ".join([
    f"SELECT r.run_id, 'FEW_FACTS' AS code, CAST(NULL AS BIGINT) AS place, CAST(count(fact_ord) AS VARCHAR) AS detail FROM out_runs r LEFT JOIN out_facts f ON f.run_id = r.run_id GROUP BY r.run_id HAVING count(fact_ord) < {rules.LEAST_FACTS}",
    *[_memo("TEMPLATE_MARKER", f"regexp_matches(markdown, {text('(?i)' + p)})", text(p)) for p in rules.TEMPLATES],
    *[_memo("WEAK_REASON", f"contains(memo, 'why it matters: {w}')", f"'{w}'") for w in rules.WEAK_REASONS],
    _memo("RAW_JSON_MEMO", "regexp_matches(markdown, '^[ \\t\\n\\r]*\\{')", "substr(markdown, 1, 20)"),
    *[_memo("FINAL_DETERMINATION", f"regexp_matches(memo, {text(p)})", text(p)) for p in rules.FINAL],
    f"""SELECT run_id, 'MALFORMED_MEMO', NULL, why FROM (SELECT run_id, CASE WHEN (length(markdown) - length(replace(markdown, '```', ''))) / 3 % 2 = 1 THEN 'unbalanced fenced code block'
      WHEN strpos(chr(10) || markdown, chr(10) || '#### ') > 0 AND (strpos(chr(10) || markdown, chr(10) || '### ') = 0 OR strpos(chr(10) || markdown, chr(10) || '### ') > strpos(chr(10) || markdown, chr(10) || '#### ')) THEN 'fourth-level heading appears before third-level heading'
      WHEN NOT ({_ORDER}) THEN 'required memo sections are missing or out of order' END AS why FROM out_runs) WHERE why IS NOT NULL""",
    _memo("SECURITY_PATH_UNNAMED", f"run_id IN (SELECT run_id FROM out_facts WHERE category = '{rules.SECURITY_CATEGORY}' OR name IN ({', '.join(map(text, rules.SECURITY_NAMES))})) AND NOT contains(CASE WHEN strpos(lower(markdown), '{rules.CONCLUSION}') > 0 THEN substr(lower(markdown), strpos(lower(markdown), '{rules.CONCLUSION}')) ELSE lower(markdown) END, '{rules.SECURITY_PATH}')", f"'{rules.SECURITY_PATH}'"),
    f"""SELECT r.run_id, 'STALE_MARKER', NULL, marker FROM (SELECT *, CASE {" ".join(f"WHEN contains(upper(title), '{d}') THEN '{d}'" for d, _ in rules.STALE_MARKERS)} ELSE (SELECT arg_min(upper(value), fact_ord) FROM out_facts f WHERE f.run_id = o.run_id AND name = 'part_number' AND upper(value) IN ({", ".join(f"'{d}'" for d, _ in rules.STALE_MARKERS)})) END AS device FROM out_runs o) r
      JOIN {_STALE} AS v(device, marker) ON v.device = r.device WHERE contains(memo, lower(marker)) AND NOT contains(source, lower(marker))""",
    _memo("RADIATION_UNSUPPORTED", f"regexp_matches(markdown, '\\bSEL\\b') AND NOT {holds('memo', rules.RADIATION_CONTEXT)}", "'SEL'"),
    _memo("CHANNEL_WORDING", "contains(markdown, '1 channels')", "'1 channels'"),
    f"SELECT run_id, 'GENERIC_INTERFACE', fact_ord, value FROM out_facts f WHERE name = 'digital_interface' AND EXISTS (SELECT 1 FROM out_facts g WHERE g.run_id = f.run_id AND g.name IN {_SPECIFIC} AND g.family = f.family)",
    _fact("SNIPPET_MISSING", "coalesce(snippet, '') = ''", "name"), _fact("REASON_MISSING", "coalesce(importance, '') = ''", "name"), _fact("BOILERPLATE_MANUFACTURER", f"name = 'manufacturer' AND {_BOILER}"),
    _fact("LEGAL_PART_NUMBER", f"name = 'part_number' AND lower(value) IN ({', '.join(map(text, rules.LEGAL_PARTS))})", "value"), _fact("RESOLUTION_OUT_OF_CONTEXT", f"name = 'adc_resolution' AND {holds('shown', rules.RESOLUTION_CONTEXT)}"),
    _fact("CHANNEL_MODE_OUT_OF_CONTEXT", f"name = 'channel_modes' AND {holds('shown', rules.CHANNEL_CONTEXT)}"), _fact("MEMORY_ECC_AS_CRYPTO", f"name = 'cryptographic_algorithm' AND upper(value) = 'ECC' AND {holds('shown', rules.MEMORY_CONTEXT)}"),
    _fact("PWM_AS_MODULATION", "name = 'modulation_feature' AND (contains(lower(value), 'pwm') OR contains(shown, 'pwm'))"), _fact("PICOSECONDS_AS_SYSTEM", "name IN ('processing_system', 'ps_pl_integration') AND regexp_matches(shown, '\\bps\\b') AND contains(shown, 'picosecond')"),
    _fact("FORMULA_AS_PERFORMANCE", f"name = 'enob' AND {holds('shown', rules.FORMULA_CONTEXT)}"),
    f"SELECT run_id, 'QUESTION_REPEATED', NULL, q FROM out_asked GROUP BY run_id, q HAVING count(*) > {rules.MOST_REPEATS}",
    f"""SELECT run_id, 'IDENTITY_DOMINATED', cand_ord, array_to_string(list_slice(string_split(claims, '|'), 1, 4), ', ') FROM out_candidates WHERE len(string_split(claims, '|')) >= {rules.LEAST_CLAIMS}
      AND 2 * len(list_filter(string_split(claims, '|'), lambda x: {" OR ".join(f"starts_with(lower(x), '{p}')" for p in rules.IDENTITY_LABELS)})) > len(string_split(claims, '|'))""",
    f"SELECT run_id, 'FACT_UNGROUNDED', cand_ord, x FROM (SELECT run_id, cand_ord, unnest(string_split(claims, '|')) AS x FROM out_candidates) c WHERE NOT {holds('lower(x)', rules.UNCLAIMED)} AND NOT EXISTS (SELECT 1 FROM out_facts f WHERE f.run_id = c.run_id AND f.told = {_normal('x')})",
    f"""SELECT run_id, 'CITATION_UNGROUNDED', cand_ord, x FROM (SELECT run_id, cand_ord, unnest(string_split(cited, '|')) AS x FROM out_candidates WHERE cited <> '') c WHERE NOT EXISTS (SELECT 1 FROM out_facts f WHERE f.run_id = c.run_id AND f.shown = {_normal('x')})
      AND NOT EXISTS (SELECT 1 FROM out_runs r WHERE r.run_id = c.run_id AND contains(r.source, {_normal('x')}))""",
    f"""SELECT run_id, 'QUESTION_UNGROUNDED', cand_ord, token FROM ({_TOKENS}) c WHERE NOT EXISTS (SELECT 1 FROM out_runs r WHERE r.run_id = c.run_id AND contains(r.source, token)) AND NOT EXISTS (SELECT 1 FROM out_facts f WHERE f.run_id = c.run_id AND contains(f.told, token))""",
])
STEPS["out_runs"] = f"SELECT *, {_normal('markdown')} AS memo, {_normal('text')} AS source FROM ({RUNS})"
STEPS["out_candidates"] = CANDIDATES
STEPS["out_facts"] = f"""SELECT *, {_normal('snippet')} AS shown, {_FAMILY} AS family, {_normal(f"{_LABEL} || ': ' || value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END")} AS told FROM ({FACTS})"""
STEPS["out_asked"] = "SELECT run_id, cand_ord, unnest(string_split(questions, '|')) AS q FROM out_candidates"


@query("output_checks", _CHECKS)
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part", "documents", "lineitem")
    lists = {c: F.filter(F.split(c, r"\|"), lambda x: x != "") for c in ("claims", "cited", "questions")}
    return op.output_checks(spark.sql(RUNS), spark.sql(FACTS), spark.sql(CANDIDATES).withColumns(lists))

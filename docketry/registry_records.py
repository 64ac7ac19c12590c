"""Decision records, the assertions over them and their reports, over briefs with the facts of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.operators import records as rc
from docketry.oracles import STEPS, holds, text, values
from docketry.plans.classify import classify
from docketry.registry import _FORM, _REGULATIONS, ORACLES, confidence_of, joined, query
from docketry.registry_outputs import _LABEL, FACTS
from docketry.rules import decision as dr
from docketry.rules import records as rules
from docketry.rules import wording as wd

#: The profile that a provider proposed, the codes of an earlier stage, and evidence of another product.
_BACKEND = "CASE doc_id % 4 WHEN 0 THEN 'ai_accelerator' WHEN 1 THEN 'networking_hardware' END"
_PRIOR = "SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE p_partkey % 3 WHEN 0 THEN '5A002' WHEN 1 THEN '9A012' ELSE '3A001' END AS code FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT), '7A003' FROM part WHERE p_partkey % 5 = 0"
_ENTITY = "CASE WHEN doc_id % 10 = 0 AND length(quote) % 2 = 0 THEN 'entity:other' END"
_CONFIDENCE = "CASE fact_ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
_TITLE = "CASE WHEN doc_id % 7 <> 0 THEN 'sheet-' || CAST(doc_id AS VARCHAR(12)) || '.txt' END"
#: What befalls a memo before it is checked.
_DAMAGE = """CASE doc_id % 8 WHEN 0 THEN replace(memo, 'Canonical product profile: ', 'Canonical product profile: not ') WHEN 1 THEN memo || ' See 9X999 and 3A001.' WHEN 2 THEN memo || ' Advanced computing and Category 5 Part 2.'
  WHEN 3 THEN memo || ' It does not affirm network crypto.' WHEN 4 THEN replace(memo, 'ev_', 'id_') WHEN 5 THEN substr(memo, 1, 400) ELSE memo END"""


def _triples(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM {values(rows)} AS v({names})"


_IDS = "list(evidence_id ORDER BY start, signal)"
_NETWORK = "(" + ", ".join(map(text, rules.NETWORK_CRYPTO_KEYS)) + ")"
STEPS.update({
    "rec_docs": f"SELECT b.doc_id, f.form, {_BACKEND.replace('doc_id', 'b.doc_id')} AS backend, CASE f.form {' '.join(f'WHEN {text(f)} THEN regexp_extract(lower(b.text), {text(p)})' for f, p in dr.FORMS)} END AS words FROM briefs b JOIN ({_FORM}) f ON f.doc_id = b.doc_id",
    "rec_evidence": f"SELECT *, lower(quote) AS low, coalesce({_ENTITY}, 'entity:' || doc_id) AS entity FROM evidence",
    "rec_facts": f"SELECT run_id AS doc_id, fact_ord, name, value, unit, snippet, category, {_CONFIDENCE} AS confidence FROM ({FACTS})",
    "rec_named": f"SELECT d.doc_id, {_IDS} AS ids FROM rec_docs d JOIN rec_evidence e ON e.doc_id = d.doc_id WHERE contains(low, words) GROUP BY d.doc_id",
    "rec_support": "SELECT doc_id, flatten(list(evidence_ids ORDER BY signal)) AS ids FROM signals GROUP BY doc_id",
    "rec_score": ORACLES["profile_confidence"].replace("WITH ", "SELECT * FROM (WITH ", 1) + ")",
    "rec_profile": f"""SELECT d.doc_id, d.form, d.backend, r.profile AS main, coalesce(CASE d.form {' '.join(f'WHEN {text(f)} THEN {text(p)}' for f, p in dr.FORM_PROFILES)} END, r.profile) AS profile, coalesce(n.ids, s.ids, CAST([] AS VARCHAR[])) AS ids FROM rec_docs d JOIN ranked r ON r.doc_id = d.doc_id AND r.rank = 1
        LEFT JOIN rec_named n ON n.doc_id = d.doc_id LEFT JOIN rec_support s ON s.doc_id = d.doc_id""",
    "rec_keys": _triples([(s, i, k) for s, ks in rules.CAPABILITY_KEYS for i, k in enumerate(ks)], "signal, pos, key"),
    "rec_signals": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, signal) AS place FROM (SELECT doc_id, signal, min(start) AS start, CASE WHEN bool_or(polarity = 'present') THEN 'present' WHEN bool_or(polarity = 'ambiguous') THEN 'configuration_dependent' WHEN bool_or(polarity = 'absent') THEN 'absent' ELSE 'unknown' END AS presence, {_IDS} AS ids FROM rec_evidence GROUP BY doc_id, signal)""",
    "rec_all_caps": f"""SELECT s.doc_id, place, coalesce(pos, 0) AS pos, coalesce(key, s.signal) AS key, presence, ids FROM rec_signals s LEFT JOIN rec_keys k ON k.signal = s.signal
        UNION ALL SELECT e.doc_id, any_value(place), 10 + v.pos, v.key, 'present', list(e.evidence_id ORDER BY e.start) FROM rec_evidence e JOIN rec_signals s ON s.doc_id = e.doc_id AND s.signal = e.signal JOIN {values([(i, k, t) for i, (k, t) in enumerate(rules.INTEGRITY_TERMS)])} AS v(pos, key, term) ON contains(low, term) WHERE e.signal = 'platform_security' GROUP BY e.doc_id, v.pos, v.key""",
    "rec_caps": f"""SELECT * FROM rec_all_caps UNION ALL SELECT doc_id, 1000, 0, 'device_integrity_only', 'present', ids FROM rec_all_caps a WHERE key = 'platform_integrity' AND presence = 'present'
        AND NOT EXISTS (SELECT 1 FROM rec_all_caps b WHERE b.doc_id = a.doc_id AND b.key IN {_NETWORK} AND b.presence IN ('present', 'configuration_dependent'))""",
    "rec_leads": _triples([(i, k, t, j, s) for i, (k, t, ss, _) in enumerate(dr.CANONICAL) for j, s in enumerate(ss)], "pos, path_key, title, spos, signal"),
    "rec_direct": "SELECT e.doc_id, l.pos, l.path_key, l.title, l.spos, e.start, e.signal, e.evidence_id, e.polarity FROM rec_evidence e JOIN rec_leads l ON l.signal = e.signal WHERE e.polarity IN ('present', 'ambiguous')",
    "rec_triggers": f"""SELECT * FROM rec_direct UNION ALL SELECT e.doc_id, 5, 'sensor_industrial', {text(dr.CANONICAL[5][1])}, 0, e.start, e.signal, e.evidence_id, e.polarity FROM rec_evidence e JOIN rec_docs d ON d.doc_id = e.doc_id AND d.form = 'gateway' WHERE contains(low, 'gateway')
        AND NOT EXISTS (SELECT 1 FROM rec_direct x WHERE x.doc_id = e.doc_id AND x.path_key = 'sensor_industrial')""",
    "rec_opened": "SELECT doc_id, pos, path_key, title, CASE WHEN bool_and(polarity = 'ambiguous') THEN 'configuration_dependent' ELSE 'direct_positive' END AS trigger_type, list(evidence_id ORDER BY spos, start, signal) AS ids FROM rec_triggers GROUP BY doc_id, pos, path_key, title",
    "rec_required": _triples([(k, i, r) for k, _, _, rs in dr.CANONICAL for i, r in enumerate(rs)], "path_key, rpos, requirement"),
    "rec_extra": _triples([(f, 100 + i, r) for f, rs in dr.FORM_REQUIREMENTS for i, r in enumerate(rs)], "form, rpos, requirement"),
    "rec_words": _triples([(r, k) for r, ks in dr.KEYWORDS for k in ks], "requirement, word"),
    "rec_met": f"SELECT doc_id, requirement, {_IDS} AS ids FROM (SELECT DISTINCT e.doc_id, w.requirement, e.evidence_id, e.start, e.signal FROM rec_evidence e JOIN rec_words w ON contains(low, word) WHERE polarity = 'present') GROUP BY doc_id, requirement",
    "rec_needs": """SELECT n.doc_id, n.path_key, n.pos, n.requirement, n.rpos, m.ids FROM (SELECT doc_id, path_key, pos, requirement, min(rpos) AS rpos FROM (SELECT o.doc_id, o.path_key, o.pos, r.requirement, r.rpos FROM rec_opened o JOIN rec_required r ON r.path_key = o.path_key
        UNION ALL SELECT o.doc_id, o.path_key, o.pos, x.requirement, x.rpos FROM rec_opened o JOIN rec_docs d ON d.doc_id = o.doc_id JOIN rec_extra x ON x.form = d.form) GROUP BY doc_id, path_key, pos, requirement) n LEFT JOIN rec_met m ON m.doc_id = n.doc_id AND m.requirement = n.requirement""",
    "rec_lacks": "SELECT doc_id, path_key, list(requirement ORDER BY rpos) AS lacks FROM rec_needs WHERE ids IS NULL GROUP BY doc_id, path_key",
    "rec_questions": "SELECT doc_id, requirement, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos * 1000 + rpos)) AS place FROM rec_needs WHERE ids IS NULL GROUP BY doc_id, requirement",
    "rec_gated": f"""SELECT *, CASE WHEN ids IS NULL THEN 'rejected' WHEN len(blockers) > 0 THEN 'blocked' ELSE 'eligible' END AS status FROM (SELECT c.doc_id, c.ordinal, c.code, c.k AS path_key, o.title, o.ids, coalesce(l.lacks, CAST([] AS VARCHAR[])) AS lacks,
        list_concat(list_filter([CASE WHEN o.ids IS NULL THEN 'no_positive_path_trigger_evidence' END, CASE WHEN g.code IS NULL THEN '{rules.NO_TEXT}' END], lambda x: x IS NOT NULL), list_transform(coalesce(l.lacks, CAST([] AS VARCHAR[])), lambda x: replace(x, ' ', '_') || '_unknown')) AS blockers
        FROM (SELECT *, CASE path_key {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dr.ALIASES)} ELSE path_key END AS k FROM candidates) c LEFT JOIN rec_opened o ON o.doc_id = c.doc_id AND o.path_key = c.k LEFT JOIN rec_lacks l ON l.doc_id = c.doc_id AND l.path_key = c.k LEFT JOIN ({_REGULATIONS}) g ON g.code = c.code AND g.verification_status = 'current')""",
    "rec_moves": f"""SELECT doc_id, 0 AS part, 0 AS ordinal, code, 'withdrawn' AS to_status, 'not_reproposed_by_canonical_path_rules' AS reasons FROM (SELECT DISTINCT * FROM ({_PRIOR})) p WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.doc_id = p.doc_id AND c.code = p.code)
        UNION ALL SELECT doc_id, 1, ordinal, code, status, concat_ws(',', CASE WHEN status = 'rejected' THEN 'review_path_not_open' END, CASE WHEN len(blockers) > 0 THEN array_to_string(blockers, ',') END) FROM rec_gated""",
    "rec_components": f"SELECT r.doc_id, r.rank, r.profile FROM ranked r JOIN rec_profile p ON p.doc_id = r.doc_id WHERE r.profile IN ({', '.join(map(text, rules.COMPONENT_PROFILES))}) AND r.profile <> p.profile",
    "rec_resolution": f"""SELECT doc_id, 0 AS pos, 'provider_extraction' AS stage, backend AS proposed, profile, 'overridden' AS status, {text(rules.OVERRIDDEN)} AS reason FROM rec_profile WHERE backend <> profile
        UNION ALL SELECT doc_id, 1, 'component_profile_heuristics', main, profile, 'reclassified_as_component', {text(rules.RECLASSIFIED)} FROM rec_profile WHERE main <> profile""",
})


def _per(name: str, what: str, order: str, where: str = "true", by: str = "|") -> str:
    return f"(SELECT string_agg({what}, {by if by.startswith('chr') else text(by)} ORDER BY {order}) FROM {name} x WHERE x.doc_id = d.doc_id AND {where})"


_ORACLE = f"""SELECT d.doc_id, d.form, coalesce(array_to_string(n.ids, ','), '') AS form_ids, p.profile, array_to_string(p.ids, ',') AS profile_ids, CASE WHEN d.form <> 'unknown' THEN {rules.FORM_SURE} ELSE s.confidence END AS profile_confidence,
  coalesce({_per('rec_components', 'profile', 'rank')}, '') AS components, coalesce({_per('rec_resolution', "stage || ':' || proposed || ':' || status", 'pos')}, '') AS resolution, coalesce({_per('rec_evidence', "signal || ':' || evidence_id || ':' || coalesce(scope, '')", 'start, signal', "polarity = 'ambiguous'")}, '') AS optional,
  coalesce({_per('rec_caps', f"key || '=' || presence || '=' || CASE WHEN key IN ({', '.join(map(text, rules.UNRESOLVED_KEYS))}) THEN 'unresolved' ELSE 'unknown' END || ':' || array_to_string(ids, ',')", 'place, pos')}, '') AS capabilities,
  CASE WHEN EXISTS (SELECT 1 FROM evidence x WHERE x.doc_id = d.doc_id AND x.scope = 'current_configuration') THEN 'configuration_specific' ELSE 'mixed_or_unspecified' END AS scope, coalesce({_per('rec_opened', "path_key || ':' || trigger_type || ':' || array_to_string(ids, ',')", 'pos')}, '') AS paths,
  coalesce({_per('rec_needs', "requirement || ':' || coalesce(array_to_string(ids, ','), '')", 'pos, rpos')}, '') AS requirements, {", ".join(f"coalesce({_per('rec_gated', 'code', 'ordinal', f'''x.status = '{s}' ''')}, '') AS {s}" for s in ('eligible', 'blocked', 'rejected'))},
  coalesce({_per('rec_moves', "code || ':' || to_status || ':' || reasons", 'part, ordinal, code')}, '') AS transitions, coalesce((SELECT '{rules.LIMITATION}:' || string_agg(code, ',' ORDER BY ordinal) FROM rec_gated x WHERE x.doc_id = d.doc_id AND status = 'blocked' AND list_contains(blockers, '{rules.NO_TEXT}')), '') AS limitations,
  coalesce({_per('rec_questions', 'requirement', 'place')}, '') AS missing, coalesce({_per('rec_questions', "'Provide or confirm ' || requirement || '.'", 'place')}, '') AS questions,
  concat_ws('|', CASE WHEN EXISTS (SELECT 1 FROM rec_questions x WHERE x.doc_id = d.doc_id) THEN 'missing_key_specs' END, CASE WHEN (SELECT count(*) FROM candidates x WHERE x.doc_id = d.doc_id) > 1 THEN 'multiple_plausible_eccns' END, 'requires_engineering_confirmation') AS flags,
  least(s.confidence, {rules.MOST_CONFIDENCE}) AS confidence, CASE WHEN NOT EXISTS (SELECT 1 FROM rec_opened x WHERE x.doc_id = d.doc_id) THEN {text(rules.ABSTENTION)} END AS abstention
FROM rec_docs d JOIN rec_profile p ON p.doc_id = d.doc_id LEFT JOIN rec_named n ON n.doc_id = d.doc_id LEFT JOIN rec_score s ON s.doc_id = d.doc_id"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir).selectExpr("doc_id", "text", "'Brief ' || doc_id AS title", f"{_TITLE} AS file_name")
    views.views(spark, sf_dir, "lineitem")
    c = classify(docs)
    facts = spark.sql(FACTS).withColumnRenamed("run_id", "doc_id").withColumn("confidence", F.expr(_CONFIDENCE))
    return rc.decision_records(
        docs.withColumn("backend", F.expr(_BACKEND)), c.evidence.withColumn("entity", F.expr(_ENTITY)), c.signals, c.ranked, c.candidates, facts, confidence_of(c), spark.sql(_PRIOR), spark.sql(_REGULATIONS)
    )


def _flat(rows: str | Column, *parts) -> Column:
    """An array of structs as text: parts joined by colons, rows by bars."""
    return F.array_join(F.transform(rows, lambda x: F.concat(*[c for p in parts for c in (F.lit(":"), p(x))][1:])), "|")


@query("decision_records", _ORACLE)
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda x: F.array_join(x["evidence_ids"], ",")
    return records(spark, sf_dir).select(
        "doc_id", F.col("form.value").alias("form"), F.array_join("form.evidence_ids", ",").alias("form_ids"), F.col("profile.profile").alias("profile"), F.array_join("profile.evidence_ids", ",").alias("profile_ids"), F.col("profile.confidence").alias("profile_confidence"),
        F.array_join("components", "|").alias("components"), _flat("resolution", lambda x: x["stage"], lambda x: x["proposed"], lambda x: x["status"]).alias("resolution"), _flat("optional", lambda x: x["capability"], lambda x: x["evidence_id"], lambda x: F.coalesce(x["scope"], F.lit(""))).alias("optional"),
        _flat("capabilities", lambda x: F.concat_ws("=", x["key"], x["presence"], x["significance"]), ids).alias("capabilities"), "scope", _flat("paths", lambda x: x["path_key"], lambda x: x["trigger_type"], ids).alias("paths"),
        _flat(F.flatten("paths.requirements"), lambda x: x["requirement"], ids).alias("requirements"), *[F.array_join(f"{s}.code", "|").alias(s) for s in ("eligible", "blocked", "rejected")], _flat("transitions", lambda x: x["code"], lambda x: x["to_status"], lambda x: F.array_join(x["reasons"], ",")).alias("transitions"),
        _flat("limitations", lambda x: x["code"], lambda x: F.array_join(x["candidates"], ",")).alias("limitations"), F.array_join("missing", "|").alias("missing"), F.array_join("questions", "|").alias("questions"), F.array_join("flags", "|").alias("flags"), "confidence", "abstention",
    )


_NL = "chr(10)"
_SOURCE = "SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') || chr(31) || lower(trim(value)) || chr(31) || coalesce(unit, chr(30)) AS same FROM rec_facts WHERE name <> 'manufacturer' AND value IS NOT NULL"
STEPS["rec_fact_lines"] = f"""SELECT doc_id, place, '- **' || {_LABEL} || '**: ' || value || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END || {_NL} || '  - Source: ' || sources || {_NL} || '  - Confidence: ' || confidence || '; support: ' || CASE WHEN direct THEN 'direct' ELSE 'inferred' END AS line FROM (
  SELECT f.doc_id, min(fact_ord) AS place, arg_min(name, fact_ord) AS name, arg_min(value, fact_ord) AS value, any_value(unit) AS unit, arg_min(confidence, fact_ord) AS confidence, any_value(q.sources) AS sources, bool_or(contains(lower(snippet), lower(arg_value))) AS direct
  FROM (SELECT *, first_value(value) OVER (PARTITION BY doc_id, same ORDER BY fact_ord) AS arg_value FROM ({_SOURCE})) f JOIN (SELECT doc_id, same, string_agg('“' || snippet || '”', '; ' ORDER BY first_) AS sources FROM (SELECT doc_id, same, snippet, min(fact_ord) AS first_ FROM ({_SOURCE}) GROUP BY doc_id, same, snippet) GROUP BY doc_id, same) q ON q.doc_id = f.doc_id AND q.same = f.same GROUP BY f.doc_id, f.same)"""


def _section(name: str, body: str, otherwise: str) -> str:
    return f"{_NL} || {_NL} || '## {name}' || {_NL} || coalesce({body}, {text(otherwise)})"


def _bullets(xs: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda y: '  - ' || y), {_NL})"


STEPS["rec_memos"] = f"""SELECT d.doc_id, '# Classification Memo Draft — ' || coalesce('Brief ' || d.doc_id, '') || {_NL} || {_NL} || '## Document and canonical product model' || {_NL} || '- File: ' || coalesce({_TITLE.replace('doc_id', 'd.doc_id')}, 'Not recorded') || {_NL} || '- Manufacturer: '
  || coalesce((SELECT arg_min(value, fact_ord) FROM rec_facts x WHERE x.doc_id = d.doc_id AND name = 'manufacturer' AND contains(lower(snippet), lower(value))), 'unknown') || {_NL} || '- Exported product form: ' || d.form || {_NL} || '- Canonical product profile: ' || p.profile || {_NL}
  || '- Configuration scope: ' || CASE WHEN EXISTS (SELECT 1 FROM evidence x WHERE x.doc_id = d.doc_id AND x.scope = 'current_configuration') THEN 'configuration_specific' ELSE 'mixed_or_unspecified' END || {_NL} || '- Human review required: yes' || {_NL} || {_NL} || '### Profile resolution' || {_NL}
  || coalesce({_per('rec_resolution', "'- ' || stage || ' proposed `' || proposed || '`; canonical decision uses `' || profile || '` because ' || reason", 'pos', by=_NL)}, '- Provider and canonical profile agree, or no provider profile was supplied.') || {_NL} || {_NL} || '### Installed component profiles' || {_NL}
  || coalesce({_per('rec_components', "'- ' || profile || ' (installed_component)'", 'rank', by=_NL)}, '- None established from the supplied evidence.')
  || {_section('Extracted source facts', "(SELECT nullif(concat_ws(chr(10), " + _per('rec_fact_lines', 'line', 'place', by=_NL) + ", " + _per('rec_evidence', "'- **' || replace(signal, '_', ' ') || '**: ' || array_to_string(terms, ', ') || chr(10) || '  - Evidence ID: `' || evidence_id || '`; polarity: ' || polarity || '; configuration scope: ' || coalesce(scope, 'unspecified') || '; support: direct' || chr(10) || '  - Exact quote: “' || quote || '”'", 'start, signal', by=_NL) + "), ''))", '- No material source facts were established.')}
  || {_section('Decisive negative source evidence', _per('rec_evidence', "'- **' || replace(signal, '_', ' ') || '**: absent' || chr(10) || '  - Exact quote: “' || quote || '”' || chr(10) || '  - Source location: source document; configuration scope: ' || coalesce(scope, 'unspecified')", 'start, signal', "polarity = 'absent'", by=_NL), '- No decisive negative source evidence was used in this decision.')}
  || {_section('Capability assessment', _per('rec_caps', f"'- **' || replace(key, '_', ' ') || '**: ' || presence || '; implementation unknown; user accessibility unknown; classification significance ' || CASE WHEN key IN ({', '.join(map(text, rules.UNRESOLVED_KEYS))}) THEN 'unresolved' ELSE 'unknown' END || '.'", 'place, pos', by=_NL), '- No material capabilities were established.')}
  || {_section('Open review paths', "(SELECT string_agg('### ' || x.title || chr(10) || '- Status: open' || chr(10) || '- Why opened: Opened by ' || len(x.ids) || ' normalized source evidence record(s).' || chr(10) || '- Triggering evidence IDs: ' || array_to_string(x.ids, ', ') || chr(10) || '- Missing evidence:' || chr(10) || coalesce(" + _bullets('l.lacks') + ", ''), chr(10) ORDER BY x.pos) FROM rec_opened x LEFT JOIN rec_lacks l ON l.doc_id = x.doc_id AND l.path_key = x.path_key WHERE x.doc_id = d.doc_id)", '- ' + rules.ABSTENTION)}
  || {_section('Eligible candidate ECCNs', _per('rec_gated', "'### ' || code || ' — ' || title || chr(10) || '- Status: eligible' || chr(10) || '- Triggering evidence IDs: ' || array_to_string(ids, ', ')", 'ordinal', "x.status = 'eligible'", by=_NL), '- No specific ECCN candidate is currently eligible.')}
  || {_section('Specific candidates not yet supportable', _per('rec_gated', "'### ' || code || ' — ' || title || chr(10) || '- Status: specific candidate not yet supportable' || chr(10) || '- Positive path evidence IDs: ' || array_to_string(ids, ', ') || chr(10) || '- Blocking reasons:' || chr(10) || " + _bullets('blockers') + " || chr(10) || '- Missing evidence:' || chr(10) || " + _bullets('lacks'), 'ordinal', "x.status = 'blocked'", by=_NL), '- None.')}
  || {_section('System limitations', f"(SELECT any_value({text('- ' + rules.LIMITATION_TEXT + ' (Severity: blocking; resolution owner: system.)')}) FROM rec_gated x WHERE x.doc_id = d.doc_id AND status = 'blocked' AND list_contains(blockers, '{rules.NO_TEXT}'))", '- No blocking platform limitation was recorded.')}
  || {_section('Reviewer questions', _per('rec_questions', "'- Provide or confirm ' || requirement || '.'", 'place', by=_NL), '- Confirm whether additional technical evidence is available.')}
  || {_section('ECCN review recommendation', _per('rec_opened', "'- Continue qualified review of the ' || lower(title) || '.'", 'pos', by=_NL), '- Abstain: ' + rules.ABSTENTION)}
  || {_NL} || {_NL} || '## Review state' || {_NL} || '- Classification memo draft for qualified human review.' || {_NL} || '- Internal precedent is not regulatory authority.' || {_NL} AS memo FROM rec_docs d JOIN rec_profile p ON p.doc_id = d.doc_id"""


@query("review_report", "SELECT doc_id, memo FROM rec_memos")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.review_report(records(spark, sf_dir)).select("doc_id", "memo")


def _check(code: str, passed: str, details: str = "''") -> str:
    return f"SELECT doc_id, '{code}' AS code, coalesce({passed}, false) AS passed, coalesce({details}, '') AS details FROM rec_checked d"


_KEYS = "array_to_string(list_sort(keys), '|')"
_CAP = "EXISTS (SELECT 1 FROM rec_caps x WHERE x.doc_id = d.doc_id AND x.key IN {0} AND x.presence IN {1})"
_SOME = "('present', 'configuration_dependent')"
_UNEXPECTED = f"list_sort(list_filter(list_distinct(regexp_extract_all(memo, {text(wd.CODE)})), lambda c: NOT list_contains(codes, c)))"
_SHOWN = "(contains(d.memo, x.evidence_id) OR contains(d.memo, x.quote))"
STEPS["rec_checked"] = f"""SELECT m.doc_id, {_DAMAGE.replace('doc_id', 'm.doc_id').replace('memo', 'm.memo')} AS memo, p.form, p.profile, p.backend, coalesce((SELECT list(path_key) FROM rec_opened o WHERE o.doc_id = m.doc_id), CAST([] AS VARCHAR[])) AS keys, coalesce((SELECT list(code) FROM candidates c WHERE c.doc_id = m.doc_id), CAST([] AS VARCHAR[])) AS codes,
  (SELECT bool_or(contains(low, 'network interface card') OR contains(low, 'smartnic')) FROM rec_evidence e WHERE e.doc_id = m.doc_id) AS card FROM rec_memos m JOIN rec_profile p ON p.doc_id = m.doc_id"""
_STATED = "nullif(trim(regexp_extract(memo, '(?i)Canonical product profile:\\s*([^\\n]+)', 1)), '')"
_UNTOLD = "NOT contains(lower(coalesce(snippet, '')), lower(coalesce(value, '')))"
_NETFORM = "form IN (" + ", ".join(map(text, rules.NETWORK_FORMS)) + ")"
_CHECKS = " UNION ALL ".join([
    _check("MEMO_PROFILE_MATCHES_CANONICAL", f"{_STATED} = profile", f"concat_ws('|', coalesce({_STATED}, ''), profile)"),
    _check("CROSS_ENTITY_EVIDENCE_USED", "NOT EXISTS (SELECT 1 FROM rec_evidence x WHERE x.doc_id = d.doc_id AND x.entity = 'entity:other')", _per("rec_evidence", "evidence_id", "start, signal", "entity = 'entity:other'")),
    _check("BACKEND_PROFILE_DIVERGENCE_EXPLAINED", "true", "concat_ws('|', backend, profile)"),
    _check("MEMO_CANDIDATE_MEMBERSHIP", f"len({_UNEXPECTED}) = 0", f"array_to_string({_UNEXPECTED}, '|')"), _check("CANDIDATE_SET_DIFFERENCE_EXPLAINED", "true"),
    _check("MEMO_REFERENCES_CLOSED_ADVANCED_PATH", "NOT contains(lower(memo), 'advanced comput') OR list_contains(keys, 'advanced_computing')", _KEYS), _check("MEMO_REFERENCES_CLOSED_SECURITY_PATH", "NOT contains(lower(memo), 'category 5 part 2') OR list_contains(keys, 'category_5_part_2_security')", _KEYS),
    _check("MEMO_CAPABILITY_POLARITY_CONSISTENT", f"NOT ({_CAP.format('''('transport_security')''', _SOME)} AND regexp_matches(lower(memo), 'does not affirm (?:network )?crypt'))"), _check("CAPABILITY_EXCLUSIVITY_CONTRADICTION", f"NOT ({_CAP.format('''('device_integrity_only')''', '''('present')''')} AND {_CAP.format(_NETWORK, _SOME)})"),
    _check("UNSUPPORTED_CAPABILITY", "true"), _check("NETWORK_PRODUCT_FORM_UNRESOLVED", "NOT (coalesce(card, false) AND form = 'unknown')", "form"), _check("CAPABILITY_PROFILE_PROMOTED_TO_PRODUCT", f"NOT ({_NETFORM} AND profile = 'encryption_or_crypto_device')", "concat_ws('|', form, profile)"),
    _check("NETWORK_PATH_MISSING", f"NOT ({_NETFORM} AND {_CAP.format('''('networking', 'high_speed_ethernet')''', _SOME)} AND NOT list_contains(keys, 'networking_telecom'))", _KEYS),
    _check("MANUFACTURER_HAS_SOURCE_PROVENANCE", f"NOT EXISTS (SELECT 1 FROM rec_facts x WHERE x.doc_id = d.doc_id AND name = 'manufacturer' AND {_UNTOLD})", _per("rec_facts", "value", "fact_ord", "name = 'manufacturer'")),
    *[_check("FACT_PROVENANCE_UNSUPPORTED", f"{names} IS NULL", names) for names in [_per("rec_facts", "name", "fact_ord", f"name IN ({', '.join(map(text, rules.IDENTITY_FACTS))}) AND confidence IN ('high', 'medium') AND {_UNTOLD}")]],
    *[_check("MATERIAL_EVIDENCE_OMITTED", f"{ids} IS NULL", ids) for ids in [_per("rec_evidence", "evidence_id", "evidence_id", "polarity IN ('present', 'ambiguous', 'absent') AND NOT contains(d.memo, evidence_id)")]],
    *[_check("OPEN_PATH_MISSING_EVIDENCE_COMPLETE", f"{whole} IS NULL", whole) for whole in [_per("rec_opened", "path_key", "pos", "NOT EXISTS (SELECT 1 FROM rec_lacks l WHERE l.doc_id = x.doc_id AND l.path_key = x.path_key)")]],
    _check("MISSING_EVIDENCE_EXCLUDES_SATISFIED_REQUIREMENTS", "true"), _check("CANDIDATE_BLOCKERS_COMPLETE", "true"),
    *[_check("DECISIVE_NEGATIVE_EVIDENCE_RENDERED", f"{ids} IS NULL", ids) for ids in [f"(SELECT string_agg(DISTINCT x.evidence_id, '|' ORDER BY x.evidence_id) FROM rec_evidence x WHERE x.doc_id = d.doc_id AND NOT {_SHOWN} AND (x.polarity = 'absent' OR EXISTS (SELECT 1 FROM rec_triggers t WHERE t.doc_id = x.doc_id AND t.evidence_id = x.evidence_id)))"]],
    _check("BLOCKED_HYPOTHESES_NOT_ELIGIBLE", "NOT EXISTS (SELECT 1 FROM rec_gated a JOIN rec_gated b ON a.doc_id = b.doc_id AND a.code = b.code WHERE a.doc_id = d.doc_id AND a.status = 'eligible' AND b.status = 'blocked')"),
])


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.semantic_checks(rc.review_report(records(spark, sf_dir)).withColumn("memo", F.expr(_DAMAGE)))


@query("semantic_checks", _CHECKS)
def semantic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(checks(spark, sf_dir).drop("path"), "details")


@query("run_verdicts", f"SELECT doc_id, bool_and(passed) AS valid, coalesce(string_agg(code, '|' ORDER BY code) FILTER (NOT passed), '') AS failures FROM ({_CHECKS}) GROUP BY doc_id")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(rc.run_verdicts(checks(spark, sf_dir)), "failures")

"""Registered queries of facts and what follows from them, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docketry import views
from docketry.functions import text as tx
from docketry.operators import facts as fc
from docketry.oracles import SQUASH, STEPS, either, holds, text, values
from docketry.plans.classify import classify
from docketry.registry import joined, query
from docketry.rules import facts as fr
from docketry.rules import wording as wd
from docketry.rules.signals import SIGNALS


def _before(pattern: str) -> str:
    """The text before the first match, which tells where the match starts."""
    return f"regexp_extract(text, {text('(?is)^(.*?)(?:' + pattern + ')')}, 1)"


def _line(start: str, match: str) -> str:
    line = SQUASH.format(f"regexp_extract(substr(text, 1, {start}), '[^\\n]*$') || {match} || regexp_extract(substr(text, {start} + length({match}) + 1), '^[^\\n]*')")
    return f"CASE WHEN length({line}) <= 220 THEN {line} ELSE {SQUASH.format(f'substr(text, greatest({start} - 70, 0) + 1, least({start} + length({match}) + 70, length(text)) - greatest({start} - 70, 0))')} END"


def _fact(i: int, name: str, value: str, category: str, confidence: str, pattern: str) -> str:
    return f"""SELECT doc_id, {i} AS fact_ord, {text(name)} AS name, {text(value)} AS value, CAST(NULL AS VARCHAR) AS unit, {_line('s', 'm')} AS snippet, {text(category)} AS category, {text(confidence)} AS confidence
      FROM (SELECT doc_id, text, regexp_extract(text, {text('(?i)' + pattern)}) AS m, length({_before(pattern)}) AS s FROM sheets WHERE regexp_matches(text, {text('(?i)' + pattern)}))"""  # fmt: skip


def _qualified(value: str, qualifier: str) -> str:
    q = f"lower(coalesce({qualifier}, ''))"
    w = f"CASE {q} " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in fr.QUALIFIERS) + f" ELSE {q} END"
    return f"CASE WHEN {w} = '' THEN {value} WHEN {w} IN ('>', '<', '>=', '<=') THEN {w} || {value} ELSE {w} || ' ' || {value} END"


def _measure(i: int, name: str, pattern: str, category: str) -> str:
    p = text("(?i)" + pattern)
    return f"""SELECT doc_id, {1000 + i} AS fact_ord, {text(name)} AS name, {_qualified('v', 'r')} AS value, u AS unit, {_line('s', 'm')} AS snippet, {text(category)} AS category, 'high' AS confidence
      FROM (SELECT doc_id, text, regexp_extract(text, {p}) AS m, regexp_extract(text, {p}, 1) AS r, regexp_extract(text, {p}, 2) AS v, regexp_extract(text, {p}, 3) AS u, length({_before(pattern)}) AS s FROM sheets WHERE regexp_matches(text, {p}))"""  # fmt: skip


_ECC = f"CASE WHEN {holds('lower(line)', fr.ECC_MEMORY)} THEN 'error_correction' WHEN {holds('lower(line)', fr.ECC_CRYPTO)} THEN 'elliptic_curve_crypto' ELSE 'ambiguous' END"
_FAMILY = "CASE WHEN category <> 'digital_interface' THEN '' WHEN contains(lower(value), 'displayport') THEN 'displayport' " + " ".join(f"WHEN name = {text(n)} OR lower(value) = {text(f)} THEN {text(f)}" for n, f in fr.FAMILIES) + " ELSE lower(value) END"
_TITLE = "array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_LABEL = "CASE name " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in fr.LABELS) + f" ELSE {_TITLE} END"
_COLUMNS = "doc_id, fact_ord, name, value, unit, snippet, category, confidence"

STEPS.update({
    "sheets": views.SHEETS,
    "plain_facts": " UNION ALL ".join(_fact(i, *rule) for i, rule in enumerate(fr.FACTS)),
    "measured": " UNION ALL ".join(_measure(i, *m) for i, m in enumerate(fr.MEASURES)),
    "ecc_lines": f"SELECT doc_id, no_, line, {_ECC} AS context FROM (SELECT doc_id, unnest(range(len(l))) AS no_, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM sheets)) WHERE regexp_matches(line, '(?i)\\bECC\\b')",
    "memory_facts": f"""SELECT doc_id, CAST(2000 + no_ AS INTEGER) AS fact_ord, 'memory_integrity' AS name, CASE WHEN contains(lower(line), 'tcm') THEN 'ECC-protected TCM' WHEN contains(lower(line), 'cache') THEN 'ECC-protected cache' ELSE 'ECC-protected memory/cache' END AS value,
        CAST(NULL AS VARCHAR) AS unit, {SQUASH.format('line')} AS snippet, 'memory_cache_integrity' AS category, 'high' AS confidence FROM ecc_lines WHERE context = 'error_correction'""",
    "unsorted_facts": f"SELECT {_COLUMNS} FROM plain_facts UNION ALL SELECT {_COLUMNS} FROM measured UNION ALL SELECT {_COLUMNS} FROM memory_facts",
    "single_facts": f"""SELECT doc_id, place AS fact_ord, name, value, unit, snippet, category, confidence FROM (SELECT *, min(fact_ord) OVER (PARTITION BY doc_id, name, lower(value)) AS place,
        row_number() OVER (PARTITION BY doc_id, name, lower(value) ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, fact_ord) AS n FROM unsorted_facts) WHERE n = 1""",
    "sheet_facts": f"""SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category, lower({_LABEL}), lower(value), lower(snippet), family ORDER BY fact_ord) AS n FROM
        (SELECT *, {_FAMILY} AS family FROM single_facts) f WHERE name <> 'digital_interface' OR NOT EXISTS (SELECT 1 FROM (SELECT *, {_FAMILY} AS family FROM single_facts) g WHERE g.doc_id = f.doc_id AND g.family = f.family AND g.name IN ({", ".join(text(n) for n, _ in fr.FAMILIES)}))) WHERE n = 1""",
})


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.all_facts(views.sheets(spark, sf_dir))


@query("extract_facts", f"SELECT {_COLUMNS} FROM plain_facts")
def extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.extract_facts(views.sheets(spark, sf_dir))


@query("extract_measures", f"SELECT {_COLUMNS} FROM measured")
def extract_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.extract_measures(views.sheets(spark, sf_dir))


@query("ecc_context", "SELECT doc_id, line, context FROM ecc_lines")
def ecc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.sheets(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"(?i)\bECC\b"))
    return lines.withColumn("context", fc.ecc_context(F.col("line")))


@query("memory_integrity_facts", f"SELECT {_COLUMNS} FROM memory_facts")
def memory_integrity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.memory_integrity(views.sheets(spark, sf_dir))


@query("dedupe_facts", f"SELECT {_COLUMNS} FROM single_facts")
def dedupe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.sheets(spark, sf_dir)
    return fc.dedupe_facts(fc.extract_facts(docs).unionByName(fc.extract_measures(docs)).unionByName(fc.memory_integrity(docs))).select(*fc.SCHEMA)


@query("drop_generic_facts", f"SELECT {_COLUMNS} FROM sheet_facts")
def drop_generic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query("display_name", f"SELECT DISTINCT name, {_LABEL} AS label FROM sheet_facts")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("name", fc.display_name(F.col("name")).alias("label")).distinct()


_PROVIDER = "SELECT doc_id, CAST(fact_ord + 5000 AS INTEGER) AS fact_ord, CASE fact_ord % 3 WHEN 0 THEN 'part_number' WHEN 1 THEN 'cryptographic_algorithm' ELSE name END AS name, CASE fact_ord % 6 WHEN 0 THEN 'DS100' WHEN 3 THEN 'SX9' WHEN 1 THEN 'ECC' WHEN 4 THEN 'ecc' ELSE value END AS value, unit, snippet, category, confidence FROM {facts}"
_KEPT = f"NOT (name = 'part_number' AND regexp_matches(upper(value), '^(?:DS|UG|PG|WP|XAPP)')) AND NOT (name = 'cryptographic_algorithm' AND upper(value) = 'ECC' AND NOT {holds('lower(snippet)', fr.PROVIDER_ECC)})"


@query("merge_provider_facts", f"SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name), lower(value) ORDER BY f, fact_ord) AS n FROM (SELECT *, 0 AS f FROM sheet_facts UNION ALL SELECT *, 1 FROM ({_PROVIDER.format(facts='sheet_facts')}) WHERE {_KEPT})) WHERE n = 1")
def merge_provider_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return fc.merge_provider_facts(facts, spark.sql(_PROVIDER.format(facts="{f}"), f=facts)).select(*fc.SCHEMA)


@query("group_facts", f"""SELECT doc_id, coalesce(place, {len(fr.CATEGORIES)}) AS place, f.category, coalesce(label, f.category) AS label, string_agg(name, '|' ORDER BY fact_ord, name) AS names FROM sheet_facts f
    LEFT JOIN {values([(i, c, d) for i, (c, d) in enumerate(fr.CATEGORIES)])} AS v(place, category, label) ON v.category = f.category GROUP BY doc_id, place, f.category, label""")  # fmt: skip
def group_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(fc.group_facts(_facts(spark, sf_dir)), "names")


_OWN = f"SELECT doc_id, review_group, count(*) AS facts FROM sheet_facts JOIN {values(list(fr.REVIEW_GROUPS))} AS v(category, review_group) USING (category) GROUP BY doc_id, review_group"


@query("review_groups", f"SELECT * FROM ({_OWN}) UNION ALL SELECT doc_id, '{fr.FALLBACK_GROUP}', least(count(*), 3) FROM sheet_facts WHERE doc_id NOT IN (SELECT doc_id FROM ({_OWN}) WHERE review_group = '{fr.FALLBACK_GROUP}') GROUP BY doc_id")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.review_groups(_facts(spark, sf_dir))


def _some(*names: str) -> str:
    return "bool_or(name IN (" + ", ".join(text(n) for n in names) + "))"


#: The converter of a sheet is known by its text here, as sheets hold no device type fact.
_DEVICE = "SELECT doc_id, CAST(9000 AS INTEGER) AS fact_ord, 'device_type' AS name, 'Analog-to-digital converter' AS value, CAST(NULL AS STRING) AS unit, text AS snippet, 'product_identity' AS category, 'high' AS confidence FROM {sheets} WHERE text LIKE '%Analog-to-digital%'"
_WITH_DEVICE = f"SELECT {_COLUMNS} FROM sheet_facts UNION ALL " + _DEVICE.format(sheets="sheets").replace("STRING", "VARCHAR")


@query("missing_review_points", f"""SELECT doc_id, array_to_string([x for x in [CASE WHEN c AND NOT r THEN 'resolution' END, CASE WHEN c AND NOT s THEN 'sample_rate' END, CASE WHEN c AND NOT l THEN 'output_interface' END, CASE WHEN NOT e THEN 'special_environment' END, CASE WHEN NOT k THEN 'security' END] if x IS NOT NULL][1:4], '|') AS points
    FROM (SELECT doc_id, coalesce(c, false) AS c, coalesce(r, false) AS r, coalesce(s, false) AS s, coalesce(l, false) AS l, coalesce(e, false) AS e, coalesce(k, false) AS k FROM sheets LEFT JOIN (
      SELECT doc_id, bool_or(name = 'device_type' AND {holds('lower(value)', ('adc', 'analog-to-digital', 'dac', 'digital-to-analog', 'converter'))}) AS c, {_some('adc_resolution', 'dac_resolution')} AS r, {_some('sample_rate', 'single_channel_sample_rate', 'dual_channel_sample_rate')} AS s,
        {_some('jesd_interface', 'digital_interface', 'serial_lane_rate', 'serdes_rate')} AS l, {_some('radiation_tolerance', 'space_qualification', 'military_grade', 'operating_temperature_range')} OR bool_or(category = 'environmental_qualification') AS e,
        {_some('security_feature', 'cryptographic_algorithm', 'secure_boot', 'trusted_execution')} OR bool_or(category = 'security_cryptography') AS k FROM ({_WITH_DEVICE}) GROUP BY doc_id) USING (doc_id))""")  # fmt: skip
def missing_review_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.sheets(spark, sf_dir)
    return joined(fc.missing_review_points(docs, _facts(spark, sf_dir).unionByName(spark.sql(_DEVICE.format(sheets="{s}"), s=docs))), "points")


_REPEATED = "SELECT doc_id, CAST(fact_ord AS INTEGER) AS fact_ord, name, value, category FROM {f} UNION ALL SELECT doc_id, CAST(fact_ord + 1 AS INTEGER), name, value, category FROM {f} WHERE fact_ord % 4 = 0 UNION ALL SELECT DISTINCT doc_id, CAST(9500 AS INTEGER), 'is_family_overview', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, 'product_identity' FROM {f}"


@query("fact_issues", f"SELECT doc_id, fact_ord, 'duplicate' AS issue_type, name AS fact_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name, value ORDER BY fact_ord) AS n FROM ({_REPEATED.format(f='sheet_facts')})) WHERE n > 1 UNION ALL SELECT doc_id, 9500, 'family_scope_warning', 'is_family_overview' FROM (SELECT DISTINCT doc_id FROM sheet_facts) WHERE doc_id % 3 = 0")
def fact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the statement names them three times
    facts = _facts(spark, sf_dir).select("doc_id", "fact_ord", "name", "value", "category").persist(StorageLevel.MEMORY_AND_DISK)
    return fc.fact_issues(spark.sql(_REPEATED, f=facts))


def _pick(k: int) -> str:
    return "CASE " + " ".join(f"WHEN {holds('w', terms)} THEN {text((p, c)[k])}" for p, c, terms in fr.DEFAULT_PROFILES) + f" ELSE {text(('generic_electronics', 'low')[k])} END"


@query("default_profile", f"SELECT doc_id, {_pick(0)} AS profile, {_pick(1)} AS confidence FROM (SELECT doc_id, lower(string_agg(name || ' ' || value, ' ' ORDER BY fact_ord, name || ' ' || value)) AS w FROM ({_WITH_DEVICE}) GROUP BY doc_id)")
def default_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.sheets(spark, sf_dir)
    return fc.default_profile(_facts(spark, sf_dir).unionByName(spark.sql(_DEVICE.format(sheets="{s}"), s=docs)))


_KEYED = " UNION ALL ".join(f"SELECT {text(k)} AS key, doc_id, fact_ord, name FROM sheet_facts WHERE name IN ({', '.join(text(n) for n in names)}) OR {holds(chr(39).join(['lower(concat_ws(', ' ', ', name, value, snippet))']), tokens)}" for k, names, tokens in fr.CAPABILITIES)


@query("capability_signals", f"""SELECT s.doc_id, v.key, count(k.name) > 0 AS detected, CASE WHEN count(k.name) >= 3 THEN 'high' WHEN count(k.name) >= 1 THEN 'medium' ELSE 'low' END AS confidence, coalesce(string_agg(k.name, '|' ORDER BY k.fact_ord, k.name), '') AS names
    FROM sheets s CROSS JOIN {values([(k,) for k, _, _ in fr.CAPABILITIES])} AS v(key) LEFT JOIN ({_KEYED}) k ON k.doc_id = s.doc_id AND k.key = v.key GROUP BY s.doc_id, v.key""")  # fmt: skip
def capability_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(fc.capability_signals(views.sheets(spark, sf_dir), _facts(spark, sf_dir)), "names")


def _marks(kind: str, pattern: str, group: int) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(range(len(m))) AS at_, unnest(m) AS value FROM (SELECT doc_id, regexp_extract_all(text, {text(pattern)}, {group}) AS m FROM sheets)"


@query("extract_markers", f"""SELECT doc_id, kind, CAST(place AS INTEGER) AS place, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY at_) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(value) ORDER BY at_) AS n FROM ({_marks('identifier', fr.IDENTIFIER, 1)} UNION ALL {_marks('code', fr.HISTORY_CODE, 0)})) WHERE n = 1) WHERE place <= {fr.MOST_MARKERS}""")  # fmt: skip
def extract_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.extract_markers(views.sheets(spark, sf_dir))


_QUOTED = f"CASE WHEN regexp_matches(lower(v), {either(wd.UNKNOWN)}) THEN 'unknown' WHEN regexp_matches(lower(v), {either(wd.NEGATION)}) THEN 'absent' WHEN regexp_matches(lower(v), {either(wd.CONDITIONAL)}) THEN 'ambiguous' ELSE 'present' END"


@query("fact_evidence", f"""SELECT doc_id, fact_ord, signal, {_QUOTED} AS polarity FROM (SELECT DISTINCT f.doc_id, fact_ord, signal, {SQUASH.format("value || '. ' || snippet")} AS v FROM sheet_facts f JOIN sheets s ON s.doc_id = f.doc_id AND contains(lower({SQUASH.format('s.text')}), lower(snippet))
    JOIN terms ON contains(lower(name || ' ' || value || ' ' || snippet), term) AND regexp_matches(' ' || lower(name || ' ' || value || ' ' || snippet) || ' ', '[^a-z0-9]' || regexp_escape(term) || '[^a-z0-9]')
    WHERE snippet <> '' AND len(regexp_extract_all(snippet, '[^.!?\\n\\r]+[.!?]*')) = 1)""")  # fmt: skip
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.sheets(spark, sf_dir)
    return fc.fact_evidence(fc.all_facts(docs), docs, SIGNALS)


_KINDS = [(k, "security_cryptography" if "security" in " ".join(ps) or "crypto" in " ".join(ps) else "compute_performance" if "comput" in " ".join(ps) or "accelerator" in " ".join(ps) else "rf_microwave" if "rf_" in " ".join(ps) or "wireless" in " ".join(ps) else "normalized_technical_signal") for k, ps, _, _ in SIGNALS]
_NAMED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'heuristic_signal_' || signal ELSE signal END AS name FROM {s}"


@query("signal_facts", f"SELECT doc_id, 'heuristic_signal_' || signal AS name, array_to_string(terms, ', ') AS value, category FROM signals JOIN {values(_KINDS)} AS v(signal, category) USING (signal) WHERE doc_id % 2 = 1")
def signal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = classify(views.briefs(spark, sf_dir)).signals
    return fc.signal_facts(signals, spark.sql(_NAMED, s=signals), SIGNALS)


_SCORES = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'firmware_or_security_software' ELSE 'ai_accelerator' END AS profile, CAST(doc_id % 9 AS INTEGER) AS score FROM {s}"


@query("platform_security_floor", f"""SELECT * FROM ({_SCORES.format(s='sheets')}) UNION ALL SELECT DISTINCT doc_id, 'firmware_or_security_software', 2 FROM sheet_facts WHERE category = 'security_cryptography' AND {holds("lower(concat_ws(' ', name, value, snippet))", fr.PLATFORM_SECURITY)} AND doc_id % 2 = 1""")
def platform_security_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.sheets(spark, sf_dir)
    return fc.security_floor(fc.all_facts(docs), spark.sql(_SCORES, s=docs))


@query("text_previews", f"""SELECT doc_id, substr({SQUASH.format('text')}, 1, 60) AS preview, {SQUASH.format("substr(text, greatest(s - 120, 0) + 1, least(s + length(m) + 180, length(text)) - greatest(s - 120, 0))")} AS excerpt, {_line('s', 'm')} AS line
    FROM (SELECT doc_id, text, regexp_extract(text, '(?i)\\bECC\\b') AS m, length({_before(chr(92) + 'bECC' + chr(92) + 'b')}) AS s FROM sheets WHERE regexp_matches(text, '(?i)\\bECC\\b'))""")  # fmt: skip
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    start = F.regexp_instr(c, F.lit(r"(?i)\bECC\b")) - 1
    rows = views.sheets(spark, sf_dir).withColumn("s", start).where("s >= 0")
    return rows.select("doc_id", tx.preview(c, 60).alias("preview"), tx.excerpt_at(c, F.col("s"), F.col("s") + 3).alias("excerpt"), tx.line_at(c, F.col("s"), F.col("s") + 3).alias("line"))

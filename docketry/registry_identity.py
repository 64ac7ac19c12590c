"""Identity facts, facts kept by their surroundings and the text budget, over whole documents between made lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry import views
from docketry.operators import chunking as ck
from docketry.operators import facts as fc
from docketry.operators import identity as op
from docketry.oracles import SQUASH, STEPS, holds, text
from docketry.registry import query
from docketry.registry_facts import _ECC, _line
from docketry.registry_rollup import _spans
from docketry.rules import facts as fr
from docketry.rules import identity as rules

#: Lines that tell a product, then a document, then lines whose words have several meanings.
SOURCES = """
SELECT CAST(p_partkey AS BIGINT) AS doc_id,
  CASE p_partkey % 5 WHEN 0 THEN 'DS891 (v1.2) Product Specification' WHEN 1 THEN 'UG1085  Overview' WHEN 2 THEN 'Datasheet' WHEN 3 THEN 'DS12345 is under terms' ELSE '' END || chr(10)
  || CASE p_partkey % 7 WHEN 0 THEN 'The Zynq UltraScale+   MPSoC family' WHEN 1 THEN 'i.MX RT1170 Crossover Processors' WHEN 2 THEN 'ADC12DJ5200RF is an RF-sampling converter' WHEN 3 THEN 'LMX2594 without warranty' || chr(13) || chr(10) || 'XC7Z020-1 board' WHEN 4 THEN 'See ds7777 and AFE7444-Q1 receivers' WHEN 5 THEN 'An analog to digital converter, DAC38RF8' ELSE 'An accelerator card' END || chr(10)
  || coalesce(substr(text, 1, 200 + CAST(p_partkey AS INTEGER) % 5000), '') || chr(10)
  || CASE p_partkey % 6 WHEN 0 THEN 'Has HBM2 stacked memory.' WHEN 1 THEN 'Human-body model (HBM) at 2 kV.' WHEN 2 THEN 'With high bandwidth memory' WHEN 3 THEN 'HBM' ELSE 'Plain' END || repeat(' filler', CAST(p_partkey AS INTEGER) % 23) || chr(10)
  || CASE p_partkey % 11 WHEN 0 THEN 'QAM modulation and Upconversion' WHEN 1 THEN 'Pulse-width modulation timers' WHEN 2 THEN 'Frequency synthesis' WHEN 3 THEN 'demodulation' ELSE 'No carrier' END || repeat(' filler', CAST(p_partkey AS INTEGER) % 29) || chr(10)
  || CASE p_partkey % 13 WHEN 0 THEN 'SEU and SEL immunity under heavy ion' WHEN 1 THEN 'SEL bit field of a register' WHEN 2 THEN 'sel pin' WHEN 3 THEN 'Latch-up (SEL) after radiation' WHEN 4 THEN 'SEU, seu and again SEU under total ionizing dose' ELSE 'Calm' END || repeat(' filler', CAST(p_partkey AS INTEGER) % 31) || chr(10)
  || CASE p_partkey % 8 WHEN 0 THEN 'ECC with ECDSA signature' WHEN 1 THEN 'ECC cache' WHEN 2 THEN 'Trusted Execution, key storage and key storage' WHEN 3 THEN 'ECC in TCM' ELSE 'Open' END || repeat(' filler', CAST(p_partkey AS INTEGER) % 19) || chr(10)
  || CASE p_partkey % 9 WHEN 0 THEN 'The converter uses a pipeline' WHEN 1 THEN 'Unlike SAR ADCs this device is time-interleaved' WHEN 2 THEN 'A delta-sigma part' WHEN 3 THEN 'This ADC has SAR stages' WHEN 4 THEN 'adc12dj5200rf: flash ADC' ELSE 'Simple' END || chr(10)
  || CASE p_partkey % 10 WHEN 0 THEN 'External   clock at 3.2 GHz' WHEN 1 THEN 'CPU clock 1 GHz' WHEN 2 THEN 'SYSREF of 2GHz' WHEN 3 THEN 'Reference clock' ELSE 'End' END AS text
FROM part LEFT JOIN documents ON doc_id = p_partkey
"""


def _first(p: str, group: int = 0, c: str = "text", flags: str = "i") -> tuple[str, str, str]:
    """Whether, where and what the first match of a pattern in a column is."""
    own, before = text(f"(?{flags}){p}" if flags else p), text(f"(?s{flags})^(.*?)(?:{p})")
    return f"regexp_matches({c}, {own})", f"length(regexp_extract({c}, {before}, 1))", f"regexp_extract({c}, {own}, {group})"


_C = "doc_id, {0} AS fact_ord, {1} AS name, {2} AS value, CAST(NULL AS VARCHAR) AS unit, snippet, {3} AS category, {4} AS confidence"


def _fact(order: int | str, name: str, value: str, category: str, sure: str, rows: str) -> str:
    return f"SELECT {_C.format(order, text(name), value, text(category), text(sure))} FROM ({rows})"


def _told(p: str, group: int = 0, c: str = "text", table: str = "id_texts", flags: str = "i", where: str = "true") -> str:
    has, at, whole = _first(p, 0, c, flags)
    return f"SELECT *, {_line('s', 'm')} AS snippet FROM (SELECT *, {at} AS s, {whole} AS m, {_first(p, group, c, flags)[2]} AS v FROM {table} WHERE {has} AND {where})"


def _whole_line(start: str, match: str) -> str:
    return SQUASH.format(f"regexp_extract(substr(text, 1, {start}), '[^\\n]*$') || {match} || regexp_extract(substr(text, {start} + length({match}) + 1), '^[^\\n]*')")


_PARTS = []
for _i, _p in enumerate(rules.PART_NUMBERS):
    (_h1, _s1, _v1), (_h2, _s2, _v2) = _first(_p, 1, "top_", ""), _first(_p, 1, "text", "")
    _PARTS.append(f"SELECT doc_id, text, {_i} AS n, CASE WHEN {_h1} THEN {_s1} ELSE {_s2} END AS s, CASE WHEN {_h1} THEN {_v1} ELSE {_v2} END AS v FROM id_texts WHERE over_ = 0 AND {_h2}")
_OVER = text("(?i)" + rules.FAMILIES[0][0])
STEPS.update({
    "id_sources": SOURCES,
    "id_plain": "SELECT doc_id, replace(text, chr(13), '') AS text FROM id_sources",
    "id_texts": f"SELECT *, substr(text, 1, {rules.TOP}) AS top_, substr(text, 1, {rules.NUMBER_TOP}) AS head_, CASE WHEN regexp_matches(text, {_OVER}) THEN 1 ELSE 0 END AS over_ FROM id_plain",
    "id_parts": f"SELECT * FROM (SELECT *, {_whole_line('s', 'v')} AS line FROM ({' UNION ALL '.join(_PARTS)})) WHERE NOT {holds('lower(line)', rules.LEGAL_WORDS)} AND NOT regexp_matches(v, '^[A-Za-z]+$') AND NOT regexp_matches(v, {text('(?i)' + rules.DOCUMENT_LIKE)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1",
})
_IDENTITY = " UNION ALL ".join([
    *[_fact(10 * i + j, name, text(value), category, "high", _told(p)) for i, (p, _, facts) in enumerate(rules.FAMILIES) for j, (name, value, category) in enumerate(facts)],
    _fact(20, "document_number", "upper(v)", "product_identity", "high", _told(rules.DOCUMENT_NUMBER, 1, "head_", where="over_ = 1")),
    _fact(21, "document_type", "CASE lower(v) WHEN 'datasheet' THEN 'Data Sheet' WHEN 'overview' THEN 'Product Specification' ELSE v END", "product_identity", "medium", _told(rules.DOCUMENT_TYPE, 1, "head_", where="over_ = 1")),
    _fact(30, "part_number", "v", "product_identity", "high", f"SELECT *, {_line('s', 'v')} AS snippet FROM id_parts"),
    "SELECT doc_id, fact_ord, name, value, unit, snippet, category, confidence FROM (" + " UNION ALL ".join(f"SELECT {i} AS n, * FROM ({_fact(40, 'device_type', text(label), 'product_identity', sure, _told(p, 0, 'top_'))})" for i, (p, label, sure) in enumerate(rules.DEVICE_TYPES)) + ") QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1",
    _fact(50, "product_description", "snippet", "product_identity", "medium", f"SELECT *, {SQUASH.format('l')} AS snippet FROM (SELECT doc_id, list_filter(string_split(top_, chr(10)), lambda x: regexp_matches(x, {text('(?i)(?:' + rules.DESCRIBING + ')')}))[1] AS l FROM id_texts) WHERE l IS NOT NULL AND {holds('lower(' + SQUASH.format('l') + ')', rules.DESCRIPTION_WORDS)}"),
])


@query("extract_identity", _IDENTITY)
def extract_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extract_identity(sources(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part", "documents")
    return spark.sql(SOURCES)


def _near(size: int) -> str:
    first = f"greatest(CAST(s AS BIGINT) - {size}, 0)"
    return f"lower({SQUASH.format(f'substr(text, {first} + 1, least(CAST(s AS BIGINT) + length(m) + {size}, length(text)) - {first})')})"


def _nearby(i: int, name: str, value: str, category: str, pattern: str, size: int, need: tuple, bar: tuple, every: bool) -> str:
    STEPS[f"id_spans_{i}"] = _spans("id_texts", pattern, "doc_id")
    rows = f"SELECT *, CAST(s AS BIGINT) AS at_, {_near(size)} AS near FROM id_spans_{i}" + ("" if every else " QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s) = 1")
    kept = f"SELECT *, {_line('at_', 'm')} AS snippet FROM ({rows}) WHERE {holds('near', need) if need else 'true'} AND NOT {holds('near', bar) if bar else 'false'}"
    return f"SELECT {_C.format(3000 + i, text(name), text(value) if value else 'm', text(category), text('medium'))}, at_ FROM ({kept})"


def _built(i: int, pattern: str, name: str) -> str:
    has, at, m = _first(pattern)
    rows = f"SELECT t.*, p.v AS part FROM (SELECT *, {at} AS s, {m} AS m FROM id_texts WHERE {has}) t LEFT JOIN id_parts p ON p.doc_id = t.doc_id"
    own = f"(contains(lower({_whole_line('s', 'm')}), lower(coalesce(part, chr(0)))) OR {holds('lower(' + _whole_line('s', 'm') + ')', rules.OWN_DEVICE)})"
    return f"SELECT doc_id, {i} AS n, {text(name)} AS name, {_line('s', 'm')} AS snippet FROM ({rows}) WHERE {own} AND NOT {holds(_near(rules.CONTEXT), rules.COMPARED)}"


_CLOCK = f"SELECT *, {SQUASH.format('l')} AS snippet FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)clock|sysref') AND regexp_matches(x, '(?i)\\d+(?:\\.\\d+)?\\s*GHz'))[1] AS l FROM id_texts) WHERE l IS NOT NULL AND {holds('lower(' + SQUASH.format('l') + ')', rules.EXTERNAL_CLOCK)}"
STEPS["id_nearby"] = " UNION ALL ".join(_nearby(i, *rule) for i, rule in enumerate(rules.NEARBY))
STEPS["id_lines"] = f"SELECT doc_id, no_, line, {_ECC} AS context FROM (SELECT doc_id, unnest(range(len(l))) AS no_, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM id_sources)) WHERE regexp_matches(line, '(?i)\\bECC\\b')"
STEPS["id_context"] = f"""SELECT * FROM id_nearby
  UNION ALL SELECT {_C.format(3100, "'converter_architecture'", 'name', "'converter_performance'", "'medium'")}, 0 FROM (SELECT * FROM ({' UNION ALL '.join(_built(i, p, n) for i, (p, n) in enumerate(rules.ARCHITECTURES))}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1)
  UNION ALL SELECT {_C.format(3200, "'clocking_reference_note'", 'snippet', "'digital_interface'", "'low'")}, 0 FROM ({_CLOCK})
  UNION ALL SELECT {_C.format('2000 + no_', "'memory_integrity'", "CASE WHEN contains(lower(line), 'tcm') THEN 'ECC-protected TCM' WHEN contains(lower(line), 'cache') THEN 'ECC-protected cache' ELSE 'ECC-protected memory/cache' END", "'memory_cache_integrity'", "'high'")}, 0 FROM (SELECT *, {SQUASH.format('line')} AS snippet FROM id_lines WHERE context = 'error_correction')"""


@query("context_filtered_facts", "SELECT doc_id, CAST(min(fact_ord) AS INTEGER) AS fact_ord, name, lower(value) AS value, count(DISTINCT lower(value)) AS n, confidence FROM id_context GROUP BY doc_id, name, lower(value), confidence")
def context_filtered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which of equal facts gives the spelling and the line is told by context_snippets
    return op.context_facts(sources(spark, sf_dir)).selectExpr("doc_id", "fact_ord", "name", "lower(value) AS value", "1L AS n", "confidence")


@query("context_snippets", "SELECT doc_id, name, value, snippet, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name, lower(value) ORDER BY fact_ord, value, snippet) AS n FROM id_context) WHERE n = 1")
def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.context_facts(sources(spark, sf_dir)).select("doc_id", "name", "value", "snippet", "category")


#: Headings amid whole documents, each three times over, so that texts stand on both sides of the budget.
_LONG = """SELECT CAST(doc_id AS BIGINT) AS doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Electrical Characteristics ' WHEN 1 THEN ' Key Features ' ELSE '' END || text || CASE doc_id % 3 WHEN 0 THEN ' Secure Boot and USB ' WHEN 1 THEN ' Ethernet ' ELSE ' PACKAGE' END || text || CASE doc_id % 5 WHEN 0 THEN ' radiation' ELSE ' applications' END AS text FROM documents"""
_MOST, _WIDTH = 4000, max(rules.LEAST_WINDOW, 4000 // 18)
_HEADS = "(VALUES " + ", ".join(f"({i}, {text(h)})" for i, h in enumerate(rules.HEADINGS)) + ") AS v(i, heading)"
_BUDGET = f"""WITH RECURSIVE long_texts AS ({_LONG}), places AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, greatest(0, strpos(lower(text), heading) - 1 - {_WIDTH // 3}) AS a, least(length(text), strpos(lower(text), heading) - 1 + {_WIDTH}) AS b FROM long_texts, {_HEADS} WHERE strpos(lower(text), heading) > 0),
  chosen AS (SELECT doc_id, 0 AS k, CAST([] AS BIGINT[]) AS starts, CAST([] AS BIGINT[]) AS stops FROM long_texts WHERE length(text) > {_MOST}
    UNION ALL SELECT doc_id, CAST(pk AS INTEGER), CASE WHEN free THEN list_append(starts, a) ELSE starts END, CASE WHEN free THEN list_append(stops, b) ELSE stops END FROM (SELECT c.*, p.k AS pk, p.a, p.b, len(list_filter(range(1, len(starts) + 1), lambda i: p.b >= starts[i] AND p.a <= stops[i])) = 0 AS free FROM chosen c JOIN places p ON p.doc_id = c.doc_id AND p.k = c.k + 1)),
  joined AS (SELECT t.doc_id, text, array_to_string(list_concat([substr(text, 1, {_MOST // 3})], list_transform(range(1, len(starts) + 1), lambda i: substr(text, starts[i] + 1, stops[i] - starts[i]))), {text(rules.EXCERPT)}) AS j FROM long_texts t JOIN (SELECT doc_id, arg_max(starts, k) AS starts, arg_max(stops, k) AS stops FROM chosen GROUP BY doc_id) c ON c.doc_id = t.doc_id)
  SELECT doc_id, CASE WHEN length(j) > {_MOST} THEN substr(j, 1, {_MOST}) ELSE substr(j || {text(rules.CLOSING)} || CASE WHEN {_MOST} - length(j) > {rules.LEAST_TAIL} THEN right(text, least({_MOST} - length(j), {_MOST // 8})) ELSE '' END, 1, {_MOST}) END AS text FROM joined
  UNION ALL SELECT doc_id, text FROM long_texts WHERE length(text) <= {_MOST}"""


@query("budget_text", _BUDGET)
def budget_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "documents")
    return ck.budget_text(spark.sql(_LONG), _MOST)

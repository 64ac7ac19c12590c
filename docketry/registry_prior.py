"""The earlier rule stage and the questions to the history, over parts with the facts of a third of the orders' first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry import views
from docketry.operators import prior as op
from docketry.oracles import STEPS, holds, text, values
from docketry.registry import joined, query
from docketry.rules import prior as rules
from docketry.rules import review as rv

#: name, values of four suppliers' remainders, category
_NAMES = (
    ("product_profile", ("mcu_processor_soc", "fpga_programmable_logic_soc", "rf_transceiver", "crypto_security_device"), "profile_detection"), ("product_profile", ("generic_electronics", "other", "rf_transceiver", "mcu_processor_soc"), "profile_detection"),
    ("device_type", ("ADC", "Processor/SoC", "Digital-to-analog converter", "Accelerator"), "product_identity"), ("sample_rate", ("3", "5.2", "1", "2"), "converter_performance"), ("jesd_interface", ("JESD204B", "JESD204C", " JESD204B ", "JESD204"), "digital_interface"),
    ("rf_bandwidth", ("40 MHz", "1 GHz", "200 MHz", "40 MHz"), "rf_microwave"), ("frequency_range", ("70 MHz to 6 GHz", "1 GHz", "2 GHz", "3 GHz"), "rf_microwave"), ("cpu_core", ("Cortex-A53", "Cortex-M7", "Cortex-R5F", "Cortex-A72"), "processing_system_cpu"),
    ("memory_type", ("HBM", "DDR4", "HBM", "LPDDR4"), "compute_processor"), ("package_type", ("BGA", "QFN", "BGA", "LGA"), "packaging_lifecycle"), ("puf", ("PUF", "puf", "PUF key", "PUF"), "security_cryptography"), ("note", ("has AES", "uses SHA-2", "plain", "with tpm"), "other"),
    ("radiation_tolerance", ("100 krad", "300 krad", "50 krad", "none"), "environmental_qualification"), ("application_examples", ("radar", "phones", "drones", "labs"), "application_context"), ("performance_tops", ("96 TOPS", "4 TOPS", "", "96 TOPS"), "compute_performance"),
    ("part_number", ("SX-1", "SX-2", "SX-3", "SX-4"), "product_identity"), ("product_family", ("Alpha", "Beta", "Alpha", "Gamma"), "product_identity"), ("heuristic_signal_hbm", ("hbm", "hbm2", "hbm3", "hbm"), "compute_performance"),
)
_KINDS = values([(i, n, j, v, c) for i, (n, vs, c) in enumerate(_NAMES) for j, v in enumerate(vs)])
_FACTS = f"""SELECT CAST(l_partkey AS BIGINT) AS doc_id, CAST(l_orderkey AS BIGINT) AS fact_ord, name, value, CAST(NULL AS VARCHAR(9)) AS unit, 'line ' || CAST(l_suppkey % 3 AS VARCHAR(2)) AS snippet, category, 'high' AS confidence
FROM lineitem JOIN (SELECT * FROM {_KINDS} AS v(kind, name, way, value, category)) k ON k.kind = l_orderkey % {len(_NAMES)} AND k.way = l_suppkey % 4 WHERE l_linenumber = 1 AND l_orderkey % 3 <> 1"""
_HINTS = "SELECT CAST(l_partkey AS BIGINT) AS doc_id, CAST(l_orderkey AS BIGINT) AS place, 'record R' || CAST(l_suppkey AS VARCHAR(9)) AS hint FROM lineitem WHERE l_linenumber = 6"


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(text, names)) + ")"


_HOLDS = {
    "fpga_profile": "name = 'product_profile' AND value = 'fpga_programmable_logic_soc'", "mcu_profile": "name = 'product_profile' AND value = 'mcu_processor_soc'", "rf_profile": "name = 'product_profile' AND value = 'rf_transceiver'", "crypto_profile": "name = 'product_profile' AND value = 'crypto_security_device'",
    "generic_profile": "name = 'product_profile' AND value = 'generic_electronics'", "core": f"name IN {_in(rules.CORE_FACTS)}", "soc_fact": f"name IN {_in(rules.SOC_FACTS)} OR category IN {_in(rules.SOC_CATEGORIES)}", "rf_fact": f"name IN {_in(rules.RF_FACTS)}", "generic_fact": f"name IN {_in(rules.GENERIC_FACTS)}",
    "security_fact": f"name IN {_in(rules.SECURITY_FACTS)} OR category IN {_in(rules.SECURITY_CATEGORIES)} OR {holds('lower(name || chr(32) || value)', rules.SECURITY_WORDS)}", "security_named": f"name IN {_in(rules.SECURITY_FACTS)} OR category = 'security_cryptography'",
    "environment": "category = 'environmental_qualification'", "application": "category = 'application_context'", "security_group": "category = 'security_cryptography'", "digital": "category = 'digital_interface'",
}
STEPS["stage_facts"] = _FACTS
STEPS["stage_seen"] = "SELECT p_partkey AS doc_id, " + ", ".join(f"coalesce(bool_or({c}), false) AS {k}" for k, c in _HOLDS.items()) + f""", {holds("lower(coalesce(arg_min(value, fact_ord) FILTER (name = 'device_type'), ''))", rules.CONVERTER_WORDS)} AS converter,
  count(DISTINCT name || chr(31) || value || chr(31) || snippet || chr(31) || category) FILTER ({_HOLDS['soc_fact']}) AS soc, count(DISTINCT name || chr(31) || value || chr(31) || snippet || chr(31) || category) FILTER ({_HOLDS['rf_fact']}) AS rf FROM part LEFT JOIN stage_facts f ON f.doc_id = p_partkey GROUP BY p_partkey"""


def _rule(i: int, code: str, path: str, every: tuple, some: tuple, none: tuple, confidence: str) -> str:
    sure = {"soc": f"CASE WHEN soc >= {rules.MANY_SOC} THEN 'medium' ELSE 'low' END", "rf": f"CASE WHEN rf >= {rules.MANY_RF} THEN 'medium' ELSE 'low' END"}.get(confidence, f"'{confidence}'")
    where = [*every, *[f"NOT {b}" for b in none], *(["(" + " OR ".join(some) + ")"] if some else []), *(["NOT (core AND converter)"] if path in rules.NOT_FOR_CONVERTERS else [])]
    return f"SELECT doc_id, {i} AS ordinal, '{code}' AS code, '{path}' AS path_key, {sure} AS confidence FROM stage_seen WHERE {' AND '.join(where) or 'true'}"


@query("prior_stage_candidates", " UNION ALL ".join(_rule(i, *r) for i, r in enumerate(rules.STAGE)))
def prior_stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part", "lineitem")
    return op.prior_stage_candidates(spark.table("part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id"), spark.sql(_FACTS))


_SOURCE = f"SELECT doc_id, fact_ord, name, trim(value) AS value FROM stage_facts WHERE category NOT IN ('profile_detection', 'normalized_technical_signal') AND NOT starts_with(name, 'heuristic_signal_') AND name NOT IN {_in(rules.GENERATED)} AND trim(value) <> ''"
_PARTS = [rules.FAMILY, None, *rules.VALUE_GROUPS]
STEPS["ask_source"] = _SOURCE
#: What a question is made of, in order: families, identifiers, value groups, other values, sentences, hints.
STEPS["ask_values"] = " UNION ALL ".join(f"SELECT doc_id, {i} AS part, min(fact_ord) AS place, value FROM ask_source WHERE {f'name IN {_in(rules.IDENTIFIERS)}' if p is None else f'regexp_matches(name, {text(p)})'} GROUP BY doc_id, value" for i, p in enumerate(_PARTS)) + f" UNION ALL SELECT doc_id, 6, min(fact_ord), value FROM ask_source WHERE name NOT IN {_in((*rules.IDENTIFIERS, 'product_family'))} GROUP BY doc_id, value"
STEPS["ask_sentences"] = f"SELECT doc_id, i, s FROM (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(10), chr(30)), chr(30)) AS ss FROM briefs)) WHERE regexp_matches(s, {text('(?i)' + rules.TECHNICAL)})"
STEPS["ask_parts"] = f"SELECT doc_id, part, place, value FROM ask_values UNION ALL SELECT doc_id, 7, i, s FROM ask_sentences UNION ALL SELECT doc_id, 8, place, hint FROM ({_HINTS})"
STEPS["ask_tokens"] = f"""SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY min((part, place, value, k))) AS n FROM (SELECT doc_id, part, place, value, unnest(range(len(t))) AS k, unnest(t) AS token FROM (SELECT *, regexp_extract_all(value, {text(rv.TOKEN)}) AS t FROM ask_parts))
  WHERE lower(token) NOT IN {_in(rv.STOP_WORDS)} GROUP BY doc_id, token"""


def _list(part: int) -> str:
    return f"coalesce((SELECT string_agg(value, '|' ORDER BY place) FROM ask_values x WHERE x.doc_id = b.doc_id AND part = {part}), '')"


def _joined(parts: dict[int, int], by: str, most: int) -> str:
    case = "CASE part " + " ".join(f"WHEN {a} THEN {b}" for a, b in parts.items()) + " END"
    return f"coalesce((SELECT string_agg(value, '{by}' ORDER BY n) FROM (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY min(({case}, place))) AS n FROM ask_values WHERE part IN ({', '.join(map(str, parts))}) GROUP BY doc_id, value) x WHERE x.doc_id = b.doc_id AND n <= {most}), '')"


@query("history_questions", f"""SELECT b.doc_id, {_list(1)} AS identifiers, {_list(0)} AS families, {_list(6)} AS technical, {_joined({1: 0, 0: 1, 2: 2, 3: 3, 4: 4, 5: 5}, '; ', 10**6)} AS query,
  coalesce((SELECT string_agg(token, '|' ORDER BY n) FROM ask_tokens x WHERE x.doc_id = b.doc_id AND n <= {rv.QUERY_TERMS}), '') AS terms, {_joined({0: 0, 4: 1, 3: 2, 2: 3}, '|', rules.FALLBACK_TERMS)} AS fallback FROM briefs b""")  # fmt: skip
def history_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    views.views(spark, sf_dir, "lineitem")
    return joined(op.history_questions(docs, spark.sql(_FACTS), spark.sql(_HINTS)), "identifiers", "families", "technical", "terms", "fallback")

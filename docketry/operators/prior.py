"""The earlier rule stage, from presence alone, and the questions that current facts put to a tenant's history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.joins import large
from docketry.operators.nested import nest
from docketry.rules import prior as rules
from docketry.rules import review

_BIT = {name: 1 << i for i, name in enumerate(rules.BITS)}


def _mask(names: tuple[str, ...]) -> int:
    return sum(_BIT[n] for n in names)


def presence(facts: DataFrame) -> DataFrame:
    """(doc_id, mask, soc, rf): the bits of rules.BITS that the facts of a document set, and how many different facts of two kinds it has; one aggregate."""
    name, value, category = F.col("name"), F.coalesce("value", F.lit("")), F.col("category")
    profile = lambda p: (name == "product_profile") & (value == p)
    security = name.isin(*rules.SECURITY_FACTS) | category.isin(*rules.SECURITY_CATEGORIES) | tx.contains_any(F.lower(F.concat_ws(" ", name, value)), rules.SECURITY_WORDS)
    soc = name.isin(*rules.SOC_FACTS) | category.isin(*rules.SOC_CATEGORIES)
    rf = name.isin(*rules.RF_FACTS)
    holds = {
        "fpga_profile": profile("fpga_programmable_logic_soc"), "mcu_profile": profile("mcu_processor_soc"), "rf_profile": profile("rf_transceiver"), "crypto_profile": profile("crypto_security_device"), "generic_profile": profile("generic_electronics"),
        "core": name.isin(*rules.CORE_FACTS), "soc_fact": soc, "rf_fact": rf, "generic_fact": name.isin(*rules.GENERIC_FACTS), "security_fact": security, "security_named": name.isin(*rules.SECURITY_FACTS) | (category == "security_cryptography"),
        "environment": category == "environmental_qualification", "application": category == "application_context", "security_group": category == "security_cryptography", "digital": category == "digital_interface",
    }
    own = reduce(Column.bitwiseOR, [F.when(F.coalesce(c, F.lit(False)), _BIT[k]).otherwise(0) for k, c in holds.items()])
    whole = F.struct("name", "value", "unit", "snippet", "category", "confidence")
    device = F.lower(F.min_by(F.when(name == "device_type", value), F.when(name == "device_type", F.col("fact_ord"))))
    found = facts.groupBy("doc_id").agg(F.bit_or(own).alias("mask"), F.count_distinct(F.when(soc, whole)).alias("soc"), F.count_distinct(F.when(rf, whole)).alias("rf"), device.alias("device"))
    converter = F.when(tx.contains_any(F.coalesce("device", F.lit("")), rules.CONVERTER_WORDS), _BIT["converter"]).otherwise(0)
    return found.select("doc_id", F.col("mask").bitwiseOR(converter).alias("mask"), "soc", "rf")


def prior_stage_candidates(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, ordinal, code, path_key, confidence): the candidates of the earlier stage, in fixed order, for every document.

    A rule is a triple of masks: bits all of which, one of which and none of which the document must have.
    """
    rows = docs.select("doc_id").distinct().join(large(presence(facts)), "doc_id", "left").fillna(0, ["mask", "soc", "rf"])
    mask = F.col("mask")
    primary = mask.bitwiseAND(F.lit(_mask(("core", "converter")))) == _mask(("core", "converter"))
    sure = {"soc": F.when(F.col("soc") >= rules.MANY_SOC, "medium").otherwise("low"), "rf": F.when(F.col("rf") >= rules.MANY_RF, "medium").otherwise("low"), "medium": F.lit("medium"), "low": F.lit("low")}

    def candidate(i: int, code: str, path: str, every: tuple, some: tuple, none: tuple, confidence: str) -> Column:
        fits = (mask.bitwiseAND(F.lit(_mask(every))) == _mask(every)) & (mask.bitwiseAND(F.lit(_mask(none))) == 0)
        if some:
            fits &= mask.bitwiseAND(F.lit(_mask(some))) != 0
        if path in rules.NOT_FOR_CONVERTERS:
            fits &= ~primary
        return F.when(fits, F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("code"), F.lit(path).alias("path_key"), sure[confidence].alias("confidence")))

    return rows.select("doc_id", F.inline(F.array_compact(F.array(*[candidate(i, *rule) for i, rule in enumerate(rules.STAGE)]))))


def _tokens(c: Column) -> Column:
    """The tokens of a text in their own spelling, without stop words."""
    return F.filter(F.regexp_extract_all(c, F.lit(f"({review.TOKEN})"), F.lit(1)), lambda t: ~F.lower(t).isin(*review.STOP_WORDS))


def _unique(values: Column) -> Column:
    """Trimmed, not empty, each once, in the order of their first places."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v, F.lit(" \t\n\x0b\x0c\r"))), lambda v: v != ""))


def history_questions(docs: DataFrame, facts: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, identifiers, families, technical, query, terms, fallback) of each document: what is asked of the history.

    Terms are the first 48 tokens of value groups, technical sentences and hints, in this order; the fallback has the
    first 24 values.  Generated facts, profiles and candidates ask nothing.  hints(doc_id, place, hint).
    """
    source = facts.where(~F.col("category").isin("profile_detection", "normalized_technical_signal") & ~F.col("name").startswith("heuristic_signal_") & ~F.col("name").isin(*rules.GENERATED))
    rows = nest("doc_id", docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), facts=source.where("value IS NOT NULL").select("doc_id", "fact_ord", "name", "value"), hints=hints.select("doc_id", "place", "hint"))
    of = lambda keep: _unique(F.transform(F.filter("facts", keep), lambda f: f["value"]))
    named = lambda f: f["name"].isin(*rules.IDENTIFIERS)
    groups = {f"group_{i}": _group(p) for i, p in enumerate(rules.VALUE_GROUPS)}
    rows = rows.withColumns({"identifiers": of(named), "families": of(lambda f: f["name"].rlike(rules.FAMILY)), "technical": of(lambda f: ~named(f) & (f["name"] != "product_family")), **groups})
    performance, memory, interfaces, security = (F.col(g) for g in groups)
    sentences = F.filter(F.split("text", r"(?:\r?\n)+|(?<=[.!?])\s+"), lambda s: s.rlike(f"(?i){rules.TECHNICAL}"))
    parts = F.concat("families", "identifiers", performance, memory, interfaces, security, "technical", sentences, F.col("hints.hint"))
    terms = F.slice(_unique(F.flatten(F.transform(parts, _tokens))), 1, review.QUERY_TERMS)
    fallback = F.slice(_unique(F.concat("families", interfaces, memory, performance)), 1, rules.FALLBACK_TERMS)
    query = F.array_join(_unique(F.concat("identifiers", "families", performance, memory, interfaces, security)), "; ")
    return rows.select("doc_id", "identifiers", "families", "technical", query.alias("query"), terms.alias("terms"), fallback.alias("fallback"))


def _group(pattern: str) -> Column:
    return _unique(F.transform(F.filter("facts", lambda f: f["name"].rlike(pattern)), lambda f: f["value"]))

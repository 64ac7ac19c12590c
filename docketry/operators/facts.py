"""Technical facts: extraction by literal patterns, measures, markers, merging, grouping and what they imply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.joins import large
from docketry.operators.profiles import rule_table
from docketry.rules import facts as rules

SCHEMA = ("doc_id", "fact_ord", "name", "value", "unit", "snippet", "category", "confidence")


def _lowered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, low): the text, empty for null, and its lower case."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))


def extract_facts(docs: DataFrame, patterns: tuple = rules.FACTS) -> DataFrame:
    """(doc_id, fact_ord, name, value, unit, snippet, category, confidence): the first match of each pattern.

    All patterns are literals of one projection, so they are compiled once and the text is read once; only those are
    searched for of which the text holds a word.
    """
    text = F.col("text")

    def fact(i: int, name: str, value: str, category: str, confidence: str, pattern: str) -> Column:
        made = lambda m: F.struct(F.lit(i).alias("fact_ord"), F.lit(name).alias("name"), F.lit(value).alias("value"), F.lit(None).cast("string").alias("unit"), tx.line_at(text, m["start"], m["stop"]).alias("snippet"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
        return tx.bound(tx.first_found(text, F.col("low"), pattern), made)

    found = F.array_compact(F.array(*[fact(i, *rule) for i, rule in enumerate(patterns)]))
    return _lowered(docs).select("doc_id", F.inline(found))


def qualified(value: Column, qualifier: Column) -> Column:
    """The value with its qualifier: signs stand before it, words and a blank too; none leaves it alone."""
    word = F.create_map(*[F.lit(x) for pair in rules.QUALIFIERS for x in pair])[tx.squash_ws(F.lower(qualifier))]
    word = F.coalesce(word, tx.squash_ws(F.lower(qualifier)))
    clean = tx.squash_ws(F.trim(value, F.lit(" ,.;:")))
    return F.when(F.coalesce(word, F.lit("")) == "", clean).when(word.isin(">", "<", ">=", "<="), F.concat(word, clean)).otherwise(F.concat(word, F.lit(" "), clean))


def extract_measures(docs: DataFrame, measures: tuple = rules.MEASURES) -> DataFrame:
    """The first value with a unit of each measure, in the columns of facts."""
    text = F.col("text")

    def fact(i: int, name: str, pattern: str, category: str) -> Column:
        part = lambda k: F.regexp_extract(text, f"(?i){pattern}", k)
        made = lambda m: F.struct(F.lit(1000 + i).alias("fact_ord"), F.lit(name).alias("name"), qualified(part(2), part(1)).alias("value"), part(3).alias("unit"), tx.line_at(text, m["start"], m["stop"]).alias("snippet"), F.lit(category).alias("category"), F.lit("high").alias("confidence"))
        return tx.bound(tx.first_found(text, F.col("low"), pattern), made)

    return _lowered(docs).select("doc_id", F.inline(F.array_compact(F.array(*[fact(i, *m) for i, m in enumerate(measures)]))))


def ecc_context(c: Column) -> Column:
    """error_correction, elliptic_curve_crypto or ambiguous: which words stand round the abbreviation, memory words first."""
    low = F.lower(c)
    return F.when(tx.contains_any(low, rules.ECC_MEMORY), "error_correction").when(tx.contains_any(low, rules.ECC_CRYPTO), "elliptic_curve_crypto").otherwise("ambiguous")


def memory_integrity(docs: DataFrame) -> DataFrame:
    """Facts of each line whose ECC speaks of memory; the value says which memory."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"(?i)\bECC\b") & (ecc_context(F.col("line")) == "error_correction"))
    low = F.lower("line")
    value = F.when(low.contains("tcm"), "ECC-protected TCM").when(low.contains("cache"), "ECC-protected cache").otherwise("ECC-protected memory/cache")
    return lines.select("doc_id", (2000 + F.col("line_no")).alias("fact_ord"), F.lit("memory_integrity").alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit"), tx.squash_ws(F.col("line")).alias("snippet"), F.lit("memory_cache_integrity").alias("category"), F.lit("high").alias("confidence"))


def all_facts(docs: DataFrame) -> DataFrame:
    """Facts, measures and memory integrity, deduplicated and without generic ones that a specific fact covers."""
    return drop_generic_facts(dedupe_facts(extract_facts(docs).unionByName(extract_measures(docs)).unionByName(memory_integrity(docs))))


def _rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """One fact for each (name, lower-case value): its place is the first one's, its content the surest one's, ties keep the first."""
    best = F.struct((-_rank(F.col("confidence"))).alias("less"), "fact_ord", "value", "unit", "snippet", "category", "confidence")
    kept = facts.groupBy("doc_id", "name", F.lower("value").alias("low")).agg(F.min("fact_ord").alias("place"), F.min(best).alias("b"))
    return kept.select("doc_id", F.col("place").alias("fact_ord"), "name", "b.value", "b.unit", "b.snippet", "b.category", "b.confidence")


def _family() -> Column:
    names = F.coalesce(*[F.when((F.col("name") == n) | (F.lower("value") == f), F.lit(f)) for n, f in rules.FAMILIES])
    return F.when(F.lower("value").contains("displayport"), "displayport").otherwise(F.coalesce(names, F.lower("value")))


def drop_generic_facts(facts: DataFrame) -> DataFrame:
    """Without generic interface facts whose family has a specific fact, then distinct by category, label, value and snippet."""
    named = facts.withColumn("family", F.when(F.col("category") == "digital_interface", _family()).otherwise(""))
    specific = F.col("name").isin(*[n for n, _ in rules.FAMILIES])
    by = Window.partitionBy("doc_id", "family")
    kept = named.withColumn("covered", F.max(specific).over(by)).where((F.col("name") != "digital_interface") | ~F.col("covered"))
    same = Window.partitionBy("doc_id", F.lower("category"), F.lower(display_name(F.col("name"))), F.lower("value"), F.lower("snippet"), "family").orderBy("fact_ord")
    return kept.withColumn("n", F.row_number().over(same)).where("n = 1").select(*SCHEMA)


def display_name(name: Column) -> Column:
    """The label of a fact name, else the name in title case."""
    labels = F.create_map(*[F.lit(x) for pair in rules.LABELS for x in pair])
    return F.coalesce(labels[name], F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def merge_provider_facts(local: DataFrame, provider: DataFrame) -> DataFrame:
    """Local and provider facts, first by place: without document numbers as part numbers and ungrounded ECC; one for each (name, value)."""
    number = (F.col("name") == "part_number") & F.upper("value").rlike("^(?:DS|UG|PG|WP|XAPP)")
    ecc = (F.col("name") == "cryptographic_algorithm") & (F.upper("value") == "ECC") & ~tx.contains_any(F.lower("snippet"), rules.PROVIDER_ECC)
    rows = local.withColumn("from", F.lit(0)).unionByName(provider.where(~number & ~ecc).withColumn("from", F.lit(1)))
    first = Window.partitionBy("doc_id", F.lower("name"), F.lower("value")).orderBy("from", "fact_ord")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def group_facts(facts: DataFrame) -> DataFrame:
    """(doc_id, place, category, label, names): facts by category in the order of display; other categories come last."""
    order = rule_table(facts.sparkSession, [(i, c, d) for i, (c, d) in enumerate(rules.CATEGORIES)], "place int, category string, label string")
    rows = facts.join(order, "category", "left")
    return rows.groupBy("doc_id", "category", "place", "label").agg(F.array_sort(F.collect_list(F.struct("fact_ord", "name"))).alias("f")).select("doc_id", F.coalesce("place", F.lit(len(rules.CATEGORIES))).alias("place"), "category", F.coalesce("label", "category").alias("label"), F.col("f.name").alias("names"))


def review_groups(facts: DataFrame) -> DataFrame:
    """(doc_id, review_group, facts): how many facts a review group holds; without facts of its own the fallback holds the first three."""
    groups = rule_table(facts.sparkSession, list(rules.REVIEW_GROUPS), "category string, review_group string")
    own = facts.join(groups, "category").groupBy("doc_id", "review_group").agg(F.count("*").alias("facts"))
    count = facts.groupBy("doc_id").agg(F.least(F.count("*"), F.lit(3)).alias("facts"))
    bare = count.join(large(own.where(F.col("review_group") == rules.FALLBACK_GROUP)), "doc_id", "left_anti").select("doc_id", F.lit(rules.FALLBACK_GROUP).alias("review_group"), "facts")
    return own.unionByName(bare)


def missing_review_points(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, points): which fact families a document lacks, four at most, in a fixed order."""
    any_name = lambda *names: F.bool_or(F.col("name").isin(*names))
    low = F.lower("value")
    had = facts.groupBy("doc_id").agg(
        F.bool_or((F.col("name") == "device_type") & tx.contains_any(low, ("adc", "analog-to-digital", "dac", "digital-to-analog", "converter"))).alias("converter"),
        any_name("adc_resolution", "dac_resolution").alias("resolution"), any_name("sample_rate", "single_channel_sample_rate", "dual_channel_sample_rate").alias("rate"),
        any_name("jesd_interface", "digital_interface", "serial_lane_rate", "serdes_rate").alias("lanes"),
        (any_name("radiation_tolerance", "space_qualification", "military_grade", "operating_temperature_range") | F.bool_or(F.col("category") == "environmental_qualification")).alias("environment"),
        (any_name("security_feature", "cryptographic_algorithm", "secure_boot", "trusted_execution") | F.bool_or(F.col("category") == "security_cryptography")).alias("security"),
    )
    rows = docs.select("doc_id").join(large(had), "doc_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    is_converter = ~no("converter")
    points = F.array_compact(F.array(
        F.when(is_converter & no("resolution"), F.lit("resolution")), F.when(is_converter & no("rate"), F.lit("sample_rate")), F.when(is_converter & no("lanes"), F.lit("output_interface")),
        F.when(no("environment"), F.lit("special_environment")), F.when(no("security"), F.lit("security")),
    ))
    return rows.select("doc_id", F.slice(points, 1, 4).alias("points"))


def fact_issues(facts: DataFrame) -> DataFrame:
    """(doc_id, fact_ord, issue_type, fact_name): each fact that repeats name and value, and family overviews."""
    n = F.row_number().over(Window.partitionBy("doc_id", "name", "value").orderBy("fact_ord"))
    overview = (F.col("name") == "is_family_overview") & (F.col("value") == "true")
    # one pass over the facts
    kinds = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("duplicate")), F.when(overview, F.lit("family_scope_warning"))))
    return facts.withColumn("n", n).select("doc_id", "fact_ord", F.explode(kinds).alias("issue_type"), F.col("name").alias("fact_name"))


def default_profile(facts: DataFrame) -> DataFrame:
    """(doc_id, profile, confidence) of documents without a profile fact, from the words of names and values."""
    words = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("fact_ord", F.concat_ws(" ", "name", "value").alias("t")))).alias("w"), F.bool_or(F.col("name") == "product_profile").alias("has"))
    text = F.lower(F.array_join(F.col("w.t"), " "))
    pick = lambda k: F.coalesce(*[F.when(tx.contains_any(text, terms), F.lit((p, c)[k])) for p, c, terms in rules.DEFAULT_PROFILES], F.lit(("generic_electronics", "low")[k]))
    return words.where("NOT has").select("doc_id", pick(0).alias("profile"), pick(1).alias("confidence"))


def capability_keys() -> Column:
    """The capabilities that a fact is a sign of: by its name or by a token of name, value or snippet."""
    hay = F.lower(F.concat_ws(" ", "name", "value", "snippet"))
    return F.array_compact(F.array(*[F.when(F.col("name").isin(*names) | tx.contains_any(hay, tokens), F.lit(k)) for k, names, tokens in rules.CAPABILITIES]))


def capability_signals(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, key, detected, confidence, names) for each document and capability."""
    found = facts.select("doc_id", "fact_ord", "name", F.explode(capability_keys()).alias("key")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("fact_ord", "name"))).alias("f"))
    every = docs.select("doc_id", F.explode(F.array(*[F.lit(k) for k, _, _ in rules.CAPABILITIES])).alias("key"))
    n = F.coalesce(F.size("f"), F.lit(0))
    return every.join(large(found), ["doc_id", "key"], "left").select("doc_id", "key", (n > 0).alias("detected"), F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("confidence"), F.coalesce(F.col("f.name"), F.array().cast("array<string>")).alias("names"))


def extract_markers(docs: DataFrame, most: int = rules.MOST_MARKERS) -> DataFrame:
    """(doc_id, kind, place, value): identifiers and control codes, each value once without regard to case, the first ``most`` of a kind."""
    text = F.coalesce("text", F.lit(""))
    kinds = (("identifier", rules.IDENTIFIER, 1), ("code", rules.HISTORY_CODE, 0))
    parts = [docs.select("doc_id", F.lit(k).alias("kind"), F.posexplode(F.regexp_extract_all(text, F.lit(p), F.lit(g))).alias("at", "value")) for k, p, g in kinds]
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy("doc_id", "kind", F.lower("value").alias("low")).agg(F.min(F.struct("at", "value")).alias("m"))
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("m.at"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "kind", "place", "m.value")


def fact_evidence(facts: DataFrame, docs: DataFrame, terms: tuple) -> DataFrame:
    """(doc_id, fact_ord, signal): facts as evidence of signals if their quote stands in the source, is one sentence and is no generated fact.  terms: (signal, profiles, weight, terms)."""
    quote = tx.squash_ws(F.col("snippet"))
    whole = docs.select("doc_id", F.lower(tx.squash_ws(F.col("text"))).alias("source"))
    rows = facts.where(~F.col("category").isin("profile_detection", "normalized_technical_signal") & ~F.col("name").startswith("heuristic_signal_")).join(large(whole), "doc_id")
    one = F.size(F.regexp_extract_all(quote, F.lit(r"[^.!?\n\r]+[.!?]*"), F.lit(0))) == 1
    rows = rows.where((quote != "") & F.col("source").contains(F.lower(quote)) & one)
    low = F.lower(F.concat_ws(" ", "name", "value", quote))
    found = F.array_compact(F.array(*[F.when(low.rlike(tx.bounded(ts)), F.lit(key)) for key, _, _, ts in terms]))
    return rows.select("doc_id", "fact_ord", F.explode(found).alias("signal"), tx.polarity(F.concat_ws(". ", "value", quote)).alias("polarity"))


def signal_facts(signals: DataFrame, facts: DataFrame, profiles: tuple) -> DataFrame:
    """(doc_id, name, value, category) of a derived fact for each matched signal, unless a fact has that name.  profiles: (signal, profiles, ...)."""
    kind = []
    for key, serves, _, _ in profiles:
        text = " ".join(serves)
        kind.append((key, "security_cryptography" if "security" in text or "crypto" in text else "compute_performance" if "comput" in text or "accelerator" in text else "rf_microwave" if "rf_" in text or "wireless" in text else "normalized_technical_signal"))
    rows = signals.join(rule_table(signals.sparkSession, kind, "signal string, category string"), "signal")
    rows = rows.select("doc_id", F.concat(F.lit("heuristic_signal_"), "signal").alias("name"), F.array_join("terms", ", ").alias("value"), "category")
    return rows.join(large(facts.select("doc_id", "name").distinct()), ["doc_id", "name"], "left_anti")


def security_floor(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """scores(doc_id, profile, score) with 2 for security software where security facts exist and the profile has no score."""
    hay = F.lower(F.concat_ws(" ", "name", "value", "snippet"))
    secure = facts.where((F.col("category") == "security_cryptography") & tx.contains_any(hay, rules.PLATFORM_SECURITY)).select("doc_id").distinct()
    scored = scores.where("profile = 'firmware_or_security_software'").select("doc_id")
    return scores.unionByName(secure.join(large(scored), "doc_id", "left_anti").select("doc_id", F.lit("firmware_or_security_software").alias("profile"), F.lit(2).cast(scores.schema["score"].dataType).alias("score")))

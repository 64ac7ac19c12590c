"""The decision: product form, canonical paths, requirements, gates and transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.functions.text import is_specific_code
from docketry.operators.profiles import rule_table
from docketry.rules import decision as rules


def product_form(docs: DataFrame) -> DataFrame:
    """(doc_id, form): the first of the ordered forms whose wording occurs, else unknown."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.coalesce(*[F.when(lowered.rlike(p), F.lit(form)) for form, p in rules.FORMS], F.lit("unknown")).alias("form"))


def resolve_profile(forms: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, form, profile, overridden): the form's own profile, else the first of the ranked ones."""
    own = rule_table(forms.sparkSession, list(rules.FORM_PROFILES), "form string, form_profile string")
    first = ranked.where("rank = 1").select("doc_id", F.col("profile").alias("ranked_profile"))
    rows = forms.join(own, "form", "left").join(large(first), "doc_id", "left")
    profile = F.coalesce("form_profile", "ranked_profile")
    return rows.select("doc_id", "form", profile.alias("profile"), F.coalesce(profile != F.col("ranked_profile"), F.lit(False)).alias("overridden"))


def capabilities(evidence: DataFrame) -> DataFrame:
    """(doc_id, signal, presence): present, configuration_dependent, absent or unknown, whatever the scope."""
    had = evidence.groupBy("doc_id", "signal").agg(*[F.bool_or(F.col("polarity") == p).alias(p) for p in ("present", "ambiguous", "absent")])
    return had.select("doc_id", "signal", F.when(F.col("present"), "present").when(F.col("ambiguous"), "configuration_dependent").when(F.col("absent"), "absent").otherwise("unknown").alias("presence"))


def canonical_paths(evidence: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, path_key, triggers, trigger_type) of paths opened by present or ambiguous evidence of their signals.

    A gateway without such evidence opens the sensor path by any evidence that names a gateway.
    """
    spark = evidence.sparkSession
    leads = rule_table(spark, [(k, s) for k, _, signals, _ in rules.CANONICAL for s in signals], "path_key string, signal string")
    direct = evidence.where("polarity IN ('present', 'ambiguous')").join(leads, "signal").select("doc_id", "path_key", "evidence_id", "polarity")
    opened = direct.where("path_key = 'sensor_industrial'").select("doc_id").distinct()
    gateways = evidence.where(F.lower("quote").contains("gateway")).join(large(forms.where("form = 'gateway'").select("doc_id")), "doc_id", "left_semi").join(large(opened), "doc_id", "left_anti")
    rows = direct.unionByName(gateways.select("doc_id", F.lit("sensor_industrial").alias("path_key"), "evidence_id", "polarity"))
    return rows.groupBy("doc_id", "path_key").agg(
        F.countDistinct("evidence_id").alias("triggers"), F.when(F.bool_and(F.col("polarity") == "ambiguous"), "configuration_dependent").otherwise("direct_positive").alias("trigger_type")
    )


def provenance_edges(evidence: DataFrame) -> DataFrame:
    """(doc_id, evidence_id, path_key): which evidence opens which path."""
    leads = rule_table(evidence.sparkSession, [(k, s) for k, _, signals, _ in rules.CANONICAL for s in signals], "path_key string, signal string")
    return evidence.where("polarity IN ('present', 'ambiguous')").join(leads, "signal").select("doc_id", "evidence_id", "path_key").distinct()


def assess_requirements(paths: DataFrame, forms: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, path_key, requirement, satisfied): by a keyword in the quote of present evidence."""
    spark = paths.sparkSession
    own = rule_table(spark, [(k, r) for k, _, _, required in rules.CANONICAL for r in required], "path_key string, requirement string")
    of_form = rule_table(spark, [(f, r) for f, required in rules.FORM_REQUIREMENTS for r in required], "form string, requirement string")
    asked = paths.join(own, "path_key").select("doc_id", "path_key", "requirement").unionByName(
        paths.join(large(forms), "doc_id").join(of_form, "form").select("doc_id", "path_key", "requirement")
    ).distinct()
    quote = F.lower("quote")
    # keywords are literals of one projection over the quotes, not a column to join by
    shown = F.array_compact(F.array(*[F.when(F.greatest(*[quote.contains(k) for k in ks], F.lit(False)), F.lit(r)) for r, ks in rules.KEYWORDS]))
    met = evidence.where("polarity = 'present'").select("doc_id", F.explode(shown).alias("requirement")).distinct().withColumn("met", F.lit(True))
    return asked.join(large(met), ["doc_id", "requirement"], "left").select("doc_id", "path_key", "requirement", F.coalesce("met", F.lit(False)).alias("satisfied"))


def gate_candidates(candidates: DataFrame, paths: DataFrame, requirements: DataFrame, regulations: DataFrame) -> DataFrame:
    """(doc_id, code, path_key, status, reasons): rejected without an open path; blocked without current text or with a requirement unmet; else eligible.

    regulations(code, verification_status).
    """
    aliases = rule_table(candidates.sparkSession, list(rules.ALIASES), "path_key string, canonical string")
    rows = candidates.join(aliases, "path_key", "left").withColumn("canonical", F.coalesce("canonical", "path_key"))
    opened = paths.select("doc_id", F.col("path_key").alias("canonical"), F.lit(True).alias("opened"))
    unmet = requirements.where("NOT satisfied").groupBy("doc_id", F.col("path_key").alias("canonical")).agg(
        F.array_sort(F.collect_set(F.concat(F.replace("requirement", F.lit(" "), F.lit("_")), F.lit("_unknown")))).alias("unmet")
    )
    current = regulations.where("verification_status = 'current'").select("code").distinct().withColumn("current", F.lit(True))
    rows = rows.join(large(opened), ["doc_id", "canonical"], "left").join(large(unmet), ["doc_id", "canonical"], "left").join(current, "code", "left")
    closed = F.col("opened").isNull()
    reasons = F.array_compact(F.array(
        F.when(closed, F.lit("review_path_not_open")), F.when(closed, F.lit("no_positive_path_trigger_evidence")), F.when(F.col("current").isNull(), F.lit("current_regulatory_text_unavailable"))
    ))
    reasons = F.concat(reasons, F.coalesce("unmet", F.array().cast("array<string>")))
    status = F.when(closed, "rejected").when(F.size("reasons") > 0, "blocked").otherwise("eligible")
    return rows.withColumn("reasons", reasons).select("doc_id", "code", F.col("canonical").alias("path_key"), status.alias("status"), "reasons")


def candidate_transitions(gated: DataFrame, prior: DataFrame) -> DataFrame:
    """(doc_id, code, from_stage, to_status, reasons): each gate's outcome, and prior codes that were not proposed again.  prior(doc_id, code)."""
    now = gated.select("doc_id", "code", F.lit("deterministic_candidate_rules").alias("from_stage"), F.col("status").alias("to_status"), "reasons")
    gone = prior.join(large(gated), ["doc_id", "code"], "left_anti").distinct()
    return now.unionByName(gone.select("doc_id", "code", F.lit("backend_local_rules").alias("from_stage"), F.lit("withdrawn").alias("to_status"), F.array(F.lit("not_reproposed_by_canonical_path_rules")).alias("reasons")))


def specific_candidates(candidates: DataFrame) -> DataFrame:
    """(doc_id, code, path_key): candidates whose code has the full format, each (code, path) once."""
    return candidates.where(is_specific_code(F.col("code"))).select("doc_id", "code", "path_key").distinct()

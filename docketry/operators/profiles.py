"""Signal and profile scores, eligibility, ranking, review paths and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.rules import profiles as rules
from docketry.rules.signals import SIGNALS


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table of fixed rows, to be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def score_signals(evidence: DataFrame, effective: DataFrame) -> DataFrame:
    """(doc_id, signal, contribution, terms, quotes, evidence_ids) of signals whose effective polarity is present."""
    weights = rule_table(evidence.sparkSession, [(k, w) for k, _, w, _ in SIGNALS], "signal string, weight int")
    rows = evidence.where("polarity = 'present'").join(large(effective.where("effective = 'present'").select("doc_id", "signal")), ["doc_id", "signal"])
    # sentences arrive in no order after a shuffle: sort by start, then cut
    ordered = F.array_sort(F.collect_list(F.struct("start", "quote", "evidence_id")))
    made = rows.groupBy("doc_id", "signal").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"), ordered.alias("rows"))
    return made.join(weights, "signal").select(
        "doc_id", "signal", (F.col("weight") + F.least(F.lit(2), F.size("terms") - 1)).alias("contribution"), "terms",
        F.transform(F.slice("rows", 1, 4), lambda r: r["quote"]).alias("quotes"), F.transform(F.slice("rows", 1, 8), lambda r: r["evidence_id"]).alias("evidence_ids"),
    )


def score_profiles(signals: DataFrame) -> DataFrame:
    """(doc_id, profile, score)."""
    serves = rule_table(signals.sparkSession, [(k, p) for k, ps, _, _ in SIGNALS for p in ps], "signal string, profile string")
    return signals.join(serves, "signal").groupBy("doc_id", "profile").agg(F.sum("contribution").cast("int").alias("score"))


def eligible_profiles(scores: DataFrame, effective: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(doc_id, profile, score, state, positive): ineligible, insufficient_score or eligible for each profile with a score or evidence."""
    spark = scores.sparkSession
    roles = [(p, s, "required") for p, req, _, _, _ in rules.CONTRACTS for s in req] + [(p, s, "excluded") for p, _, exc, _, _ in rules.CONTRACTS for s in exc]
    contract = rule_table(spark, roles, "profile string, signal string, role string")
    limits = rule_table(spark, [(p, n, t) for p, _, _, n, t in rules.CONTRACTS], "profile string, least_positive int, threshold int")
    blocked = contradictions.where("severity = 'blocking' AND resolution = 'unresolved'").select("doc_id", "signal").distinct().withColumn("blocked", F.lit(True))
    required = F.col("role") == "required"
    seen = effective.join(large(blocked), ["doc_id", "signal"], "left").join(contract, "signal").groupBy("doc_id", "profile").agg(
        F.count_if(required & (F.col("effective") == "present")).alias("positive"),
        F.bool_or((F.col("role") == "excluded") & (F.col("effective") == "absent")).alias("excluded"),
        F.bool_or(required & F.coalesce("blocked", F.lit(False))).alias("blocked"),
    )
    # a profile may have a score from signals that its contract doesn't name, or evidence without a score
    every = scores.join(large(seen), ["doc_id", "profile"], "full").join(limits, "profile").withColumn("score", F.coalesce("score", F.lit(0))).withColumn("positive", F.coalesce("positive", F.lit(0)).cast("int"))
    bad = F.coalesce("excluded", F.lit(False)) | F.coalesce("blocked", F.lit(False)) | (F.col("positive") < F.col("least_positive"))
    state = F.when(bad, "ineligible").when(F.col("score") < F.col("threshold"), "insufficient_score").otherwise("eligible")
    return every.select("doc_id", "profile", "score", state.alias("state"), "positive")


def _priority(profile: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in rules.PROFILES]), profile)


def rank_profiles(docs: DataFrame, eligibility: DataFrame) -> DataFrame:
    """(doc_id, rank, profile, score): detected profiles from 1, the primary; ``unknown`` for a document without any."""
    by_doc = Window.partitionBy("doc_id")
    found = eligibility.where("state = 'eligible'").withColumn("soc", F.bool_or(F.col("profile") == "fpga_programmable_logic_soc").over(by_doc))
    found = found.where(~(F.col("soc") & F.col("profile").isin(*rules.SUBSUMED)))
    top = F.max("score").over(by_doc)
    order = F.array_position(F.array(*[F.lit(p) for p in rules.SPECIFIC]), F.col("profile"))
    near = F.when((order > 0) & (top - F.col("score") <= rules.SPECIFIC_GAP), order)
    first = F.min(near).over(by_doc)
    found = found.withColumn("near", near).withColumn("first", first).withColumn("ahead", F.when(F.col("near") == F.col("first"), 0).otherwise(1))
    ranked = found.withColumn("rank", F.row_number().over(by_doc.orderBy("ahead", F.desc("score"), _priority(F.col("profile"))))).select("doc_id", "rank", "profile", "score")
    none = docs.select("doc_id").join(large(ranked.select("doc_id").distinct()), "doc_id", "left_anti")
    return ranked.unionByName(none.select("doc_id", F.lit(1).alias("rank"), F.lit("unknown").alias("profile"), F.lit(0).alias("score")))


def open_paths(ranked: DataFrame, effective: DataFrame) -> DataFrame:
    """(doc_id, ordinal, path_key, title): paths of the detected profiles in order, then security, radio and the general fallback."""
    spark = ranked.sparkSession
    leads = rule_table(spark, [(p, i, k) for p, keys in rules.PATHS for i, k in enumerate(keys)], "profile string, at int, path_key string")
    titles = rule_table(spark, list(rules.PATH_TITLES), "path_key string, title string")
    own = ranked.join(leads, "profile").select("doc_id", (F.col("rank") * 10 + F.col("at")).alias("place"), "path_key")
    security = effective.where("signal IN ('platform_security', 'transport_security') AND effective IN ('present', 'ambiguous')")
    radio = effective.where("signal = 'radio' AND effective = 'ambiguous'")
    general = ranked.where("rank = 1 AND profile NOT IN ('general_electronics', 'unknown')")
    more = [(security, 1_000, "category_5_part_2_security"), (radio, 1_001, "radio_wireless"), (general, 1_002, "general_electronics_fallback")]
    for rows, place, key in more:
        own = own.unionByName(rows.select("doc_id", F.lit(place).alias("place"), F.lit(key).alias("path_key")))
    first = own.groupBy("doc_id", "path_key").agg(F.min("place").alias("place"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return first.join(titles, "path_key").select("doc_id", ordinal.alias("ordinal"), "path_key", "title")


def missing_evidence(ranked: DataFrame) -> DataFrame:
    """(doc_id, ordinal, item): what is still to be shown, in the order of the profiles, each item once."""
    items = rule_table(ranked.sparkSession, [(p, i, x) for p, xs in rules.MISSING for i, x in enumerate(xs)], "profile string, at int, item string")
    first = ranked.join(items, "profile").groupBy("doc_id", "item").agg(F.min(F.col("rank") * 10 + F.col("at")).alias("place"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).alias("ordinal"), "item")


def confidence(score: Column, support: Column, missing: Column) -> tuple[Column, Column]:
    """(level, value) in whole steps of 0.005, so that no half is rounded by its binary form."""
    n = F.least(F.lit(176), 70 + 5 * score + 5 * support - 3 * F.least(missing, F.lit(6)))
    level = F.when(n >= 150, "high").when(n >= 110, "medium").otherwise("low")
    return level, F.floor((F.greatest(n, F.lit(40)) + 1) / 2).cast("double") / 100


def propose_candidates(paths: DataFrame, crypto: DataFrame) -> DataFrame:
    """(doc_id, ordinal, code, candidate_type, path_key): the crypto code is blocked without affirmed crypto evidence."""
    codes = rule_table(paths.sparkSession, list(rules.CANDIDATES), "path_key string, at int, code string")
    kind = F.when((F.col("code") == "5A002") & ~F.coalesce("supported", F.lit(False)), "blocked_candidate").otherwise("review_candidate")
    rows = paths.join(codes, "path_key").join(large(crypto.select("doc_id", "supported")), "doc_id", "left").withColumn("candidate_type", kind)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "at")).alias("ordinal"), "code", "candidate_type", "path_key")


def blocked_families(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, path_key, family): opened paths without a candidate, but for the general fallback."""
    return paths.where("path_key <> 'general_electronics_fallback'").join(large(candidates.select("doc_id", "path_key")), ["doc_id", "path_key"], "left_anti").select("doc_id", "path_key", F.col("title").alias("family"))

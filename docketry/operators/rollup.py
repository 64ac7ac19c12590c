"""One row a run: the decision's roll-up, the history section of its memo, and integrity anew for stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.functions.text import is_specific_code, squash_ws
from docketry.operators.checks import narrative_tests
from docketry.operators.facts import capability_keys
from docketry.operators.nested import nest
from docketry.rules.facts import CAPABILITIES

HEADER = "## Company History Comparison"
USES = (("precedent", "Similar company history found"), ("partial_precedent", "Partially similar company history found"), ("contrast", "Contrast record — material differences"))
ENDING = "- Internal precedent only — not regulatory authority. Reviewer confirmation remains required."
NOTHING = "- No comparable prior company history found in this organization’s indexed internal reference material.\n- Internal company history is optional reviewer context and not regulatory authority."


def decision_rollup(docs: DataFrame, evidence: DataFrame, paths: DataFrame, requirements: DataFrame, gated: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, scope, optional, missing, limited, abstention, eligible, blocked, rejected, confidence) of each document.

    scores(doc_id, confidence); it is capped at 0.85.  A document without an open path abstains.
    """
    told = evidence.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("polarity") == "ambiguous", F.col("signal")))).alias("optional"), F.bool_or(F.coalesce(F.col("scope") == "current_configuration", F.lit(False))).alias("specific")
    )
    unmet = requirements.where("NOT satisfied").groupBy("doc_id").agg(F.array_sort(F.collect_set("requirement")).alias("missing"))
    counts = gated.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "blocked", "rejected")], F.bool_or((F.col("status") == "blocked") & F.array_contains("reasons", "current_regulatory_text_unavailable")).alias("limited"))
    opened = paths.select("doc_id").distinct().withColumn("opened", F.lit(True))
    rows = docs.select("doc_id")
    for part in (told, unmet, counts, opened, scores.select("doc_id", "confidence")):
        rows = rows.join(large(part), "doc_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", F.when(F.col("specific"), "configuration_specific").otherwise("mixed_or_unspecified").alias("scope"), F.coalesce("optional", none).alias("optional"), F.coalesce("missing", none).alias("missing"), F.coalesce("limited", F.lit(False)).alias("limited"),
        F.when(F.col("opened").isNull(), "No review path has sufficient positive source evidence.").alias("abstention"), *[F.coalesce(s, F.lit(0)).alias(s) for s in ("eligible", "blocked", "rejected")], F.least("confidence", F.lit(0.85)).alias("confidence"),
    )


def comparison_section(memos: DataFrame, matches: DataFrame) -> DataFrame:
    """(run_id, markdown): the memo with its history section written anew, pools in fixed order, matches by rank.

    memos(run_id, markdown), matches(run_id, pool, use, rank, file_name, agreements, differences, blocking, locator, excerpt).
    """
    use, pool = F.col("use"), F.col("pool")
    title = F.coalesce(*[F.when(use == u, F.lit(t)) for u, t in USES], F.lit("Context record"))
    some = lambda label, c: F.when(F.size(F.col(c)) > 0, F.concat(F.lit(f"  - {label}: "), F.array_join(c, "; ")))
    body = F.array_compact(F.array(
        F.concat(F.lit("- **"), title, F.lit(" — "), F.col("file_name"), F.lit("**")), F.concat(F.lit("  - Agreements: "), F.when(F.size("agreements") > 0, F.array_join("agreements", "; ")).otherwise("none")), some("Material differences", "differences"),
        some("Blocking contradictions", "blocking"), F.when(F.col("locator") != "", F.concat(F.lit("  - Locator: "), F.col("locator"))), F.concat(F.lit("  - Source excerpt: “"), F.substring(F.regexp_replace("excerpt", r"\s+", " "), 1, 900), F.lit("”")),
    ))
    products, technical = pool == "product_precedents", pool == "technical_comparisons"
    part = F.when(products & (use != "contrast"), 0).when((products | technical) & (use == "contrast"), 1).when(pool == "counsel_guidance", 2).when(pool == "internal_policy", 3)
    rows = matches.select("run_id", part.alias("part"), technical.cast("int").alias("later"), "rank", F.array_join(body, "\n").alias("told")).where("part IS NOT NULL")
    held = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("part", "later", "rank", "told"))).alias("m"))

    def section(i: int, name: str) -> Column:
        mine = F.transform(F.filter("m", lambda x: x["part"] == i), lambda x: x["told"])
        return F.when(F.size(mine) > 0, F.concat(F.lit(f"### {name}\n"), F.array_join(mine, "\n")))

    parts = [section(i, n) for i, n in enumerate(("Product precedents", "Contrast records", "Relevant counsel guidance", "Relevant internal policy"))]
    text = F.when(F.col("m").isNull(), F.lit(f"{HEADER}\n{NOTHING}")).otherwise(F.concat_ws("\n", F.lit(HEADER), *parts, F.lit(ENDING)))
    before = F.rtrim(F.substring_index(F.coalesce("markdown", F.lit("")), f"\n{HEADER}", 1), F.lit(" \t\n\r"))
    return memos.join(large(held), "run_id", "left").select("run_id", F.concat(before, F.lit("\n\n"), text, F.lit("\n")).alias("markdown"))


def integrity_backfill(runs: DataFrame, candidates: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored runs checked anew: (run_id, status, invalid, created_paths, issues, regenerate) and the candidates with path_id and is_specific.

    runs(run_id, status), candidates(run_id, code, title, path_id), issues(run_id, code).  A code out of form is no
    specific candidate and gets a path of its own if it has none; a run with issues needs attention unless it failed.
    """
    valid = is_specific_code(F.col("code"))
    kind = F.when(F.lower("code").contains("5 part 2"), "encryption_security").otherwise("product_area")
    fresh = F.concat(kind, F.lit(":"), squash_ws(F.lower("title")))
    made = candidates.withColumn("is_specific", valid).withColumn("created", ~valid & F.col("path_id").isNull()).withColumn("path_id", F.when(~valid, F.coalesce("path_id", fresh)).otherwise(F.col("path_id")))
    many = made.groupBy("run_id").agg(F.count_if(~F.col("is_specific")).alias("invalid"), F.count_if("created").alias("created_paths"))
    found = issues.groupBy("run_id").agg(F.count("*").alias("issues"))
    rows = runs.join(large(many), "run_id", "left").join(large(found), "run_id", "left").fillna(0, ["invalid", "created_paths", "issues"])
    again = F.col("issues") > 0
    summary = rows.select("run_id", F.when(again & (F.col("status") != "failed"), "needs_attention").otherwise(F.col("status")).alias("status"), "invalid", "created_paths", "issues", again.alias("regenerate"))
    return summary, made.drop("created")


def backfill(tables: dict[str, DataFrame], gather=nest) -> DataFrame:
    """Stored runs derived anew from their own tables, a nested row a run: detected features and issues, candidates with path_id and is_specific, paths to create, citations with path_id, status and whether the memo must be written again.

    tables as of sources.relational: runs, facts, candidates, paths, citations, memos.  ``gather`` is nest, or
    nest_colocated for tables bucketed by run_id, which then exchange nothing.
    """
    t = tables
    wide = t["facts"].select("run_id", "fact_ord", capability_keys().alias("keys"))
    own = t["candidates"].select("run_id", "candidate_id", "code", "title", "path_id", "why", "why_not")
    rows = gather("run_id", t["runs"].select("run_id", "org_id", "status", "flags"), facts=wide, candidates=own, paths=t["paths"].select("run_id", "path_id", "title", "why"), citations=t["citations"].select("run_id", "citation_id", "candidate_id", "path_id"), memos=t["memos"].select("run_id", "version", "markdown"))
    keys = F.array_distinct(F.flatten("facts.keys"))
    detected = F.filter(F.lit([k for k, _, _ in CAPABILITIES]), lambda k: F.array_contains(F.col("keys"), k))

    def demoted(c: Column) -> Column:
        valid = is_specific_code(c["code"])
        kind = F.when(F.lower(c["code"]).contains("5 part 2"), "encryption_security").otherwise("product_area")
        made = F.concat(kind, F.lit(":"), squash_ws(F.lower(c["title"])))
        return F.struct(c["candidate_id"].alias("candidate_id"), c["code"].alias("code"), valid.alias("is_specific"), F.when(valid, c["path_id"]).otherwise(F.coalesce(c["path_id"], made)).alias("path_id"), (~valid & c["path_id"].isNull()).alias("created"), kind.alias("kind"), c["title"].alias("title"))

    latest = F.coalesce(F.get(F.col("memos.markdown"), F.size("memos") - 1), F.lit(""))
    whole = F.concat_ws("\n", F.array_join("paths.why", "\n"), F.array_join("candidates.why", "\n"), F.array_join("candidates.why_not", "\n"), latest)
    rows = rows.withColumns({"keys": keys, "titles": F.lower(F.array_join("paths.title", " ")), "told": F.lower(whole), "made": F.transform("candidates", demoted)}).withColumn("detected", detected)
    text = F.concat_ws("\n", "titles", "told")
    tests = narrative_tests(text, F.col("titles"), F.col("detected"), F.col("flags"), F.size("candidates"))
    bad = F.filter("made", lambda c: ~c["is_specific"])
    issues = F.concat(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests])), F.transform(bad, lambda c: F.concat(F.lit("INVALID_ECCN_CANDIDATE:"), c["code"])))
    moved = F.transform("citations", lambda x: F.struct(x["citation_id"].alias("citation_id"), x["candidate_id"].alias("candidate_id"), F.coalesce(x["path_id"], F.get(F.filter(bad, lambda c: c["candidate_id"] == x["candidate_id"]), F.lit(0))["path_id"]).alias("path_id")))
    created = F.transform(F.filter("made", lambda c: c["created"]), lambda c: F.struct(c["path_id"].alias("path_id"), c["kind"].alias("kind"), c["title"].alias("title")))
    rows = rows.withColumns({"issues": issues, "moved": moved})
    again = F.size("issues") > 0
    return rows.select(
        "run_id", "org_id", F.when(again & (F.col("status") != "failed"), "needs_attention").otherwise(F.col("status")).alias("status"), F.col("status").alias("status_before"), "detected", "issues", F.col("made").alias("candidates"), created.alias("created_paths"), F.col("moved").alias("citations"), again.alias("regenerate"),
    )

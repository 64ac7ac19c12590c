"""Runs, reviews, status events and audit: ladders, queues and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.functions.text import is_specific_code
from docketry.operators.profiles import rule_table
from docketry.rules import review as rules


def completion_status(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """(run_id, fallback_used, status, validation_status) from runs(run_id, mode, backend_status) and issues(run_id, severity)."""
    had = issues.groupBy("run_id").agg(F.bool_or(F.col("severity") == "error").alias("errors"), F.count("*").alias("n"))
    rows = runs.join(large(had), "run_id", "left")
    fallback, errors, n = F.col("mode") == "heuristic_fallback", F.coalesce("errors", F.lit(False)), F.coalesce("n", F.lit(0))
    status = F.when(F.col("backend_status") == "unknown", "unknown").when((F.col("backend_status") != "completed") | fallback | errors, "needs_attention").otherwise("completed")
    validation = F.when(errors, "failed").when(fallback | (n > 0), "warnings").otherwise("passed")
    return rows.select("run_id", fallback.alias("fallback_used"), status.alias("status"), validation.alias("validation_status"))


def check_transitions(events: DataFrame) -> DataFrame:
    """(run_id, seq, from_status, to_status, allowed) of each status change of events(run_id, seq, status)."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("seq"))
    steps = events.withColumn("from_status", before).where("from_status IS NOT NULL").withColumnRenamed("status", "to_status")
    known = rule_table(events.sparkSession, [(a, b, True) for a, b in rules.TRANSITIONS], "from_status string, to_status string, allowed boolean")
    return steps.join(known, ["from_status", "to_status"], "left").select("run_id", "seq", "from_status", "to_status", F.coalesce("allowed", F.lit(False)).alias("allowed"))


OPEN_STATES = ("pending_review", "in_review", "needs_information", "escalated", "in_technical_review")


def review_queue(runs: DataFrame) -> DataFrame:
    """Open runs that need a person, oldest update first within the tenant."""
    rows = runs.where(~F.col("archived") & F.col("requires_human_review") & F.col("workflow_state").isin(*OPEN_STATES))
    place = F.row_number().over(Window.partitionBy("org_id").orderBy("updated_at", "run_id"))
    return rows.select("org_id", "run_id", "workflow_state", "updated_at", place.alias("place"))


def list_runs(runs: DataFrame, lifecycle: str) -> DataFrame:
    """Runs that are active, archived, or all."""
    keep = {"active": ~F.col("archived"), "archived": F.col("archived"), "all": F.lit(True)}[lifecycle]
    return runs.where(keep)


def latest_review(reviews: DataFrame) -> DataFrame:
    """The newest review of each run; one aggregate, no window.  reviews(run_id, review_id, created_at, status, claimed)."""
    rows = F.struct("created_at", "review_id", "status", "claimed")
    return reviews.groupBy("run_id").agg(F.max(rows).alias("r")).select("run_id", "r.review_id", "r.status", "r.claimed", "r.created_at")


def review_label(runs: DataFrame, latest: DataFrame) -> DataFrame:
    """(run_id, code) of the review ladder."""
    rows = runs.select("run_id", "requires_human_review").join(large(latest), "run_id", "left")
    waiting = F.col("status").isNull() | (F.col("status") == "pending_review")
    code = (
        F.when(~F.col("requires_human_review"), "not_requested").when(waiting & F.coalesce("claimed", F.lit(False)), "under_review").when(waiting, "review_required")
        .when(F.col("status").isin("approved", "reviewed", "rejected"), F.col("status")).otherwise("review_required")
    )
    return rows.select("run_id", code.alias("code"))


def workflow_state(actions: DataFrame) -> DataFrame:
    """(run_id, seq, workflow_state): the state after each action; actions without a state keep the one before."""
    states = rule_table(actions.sparkSession, list(rules.WORKFLOW), "action string, state string")
    rows = actions.join(states, "action", "left")
    running = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("run_id", "seq", F.last("state", ignorenulls=True).over(running).alias("workflow_state"))


def audit_log(events: DataFrame, n: int = 100, salts: int = 16) -> DataFrame:
    """The newest n events of each tenant.  events(org_id, event_id, created_at, action).

    First the newest n of each of ``salts`` parts of a tenant, then of those, so
    that a tenant with most of the events is not sorted by one task.
    """
    newest = [F.desc("created_at"), F.desc("event_id")]
    part = F.pmod(F.xxhash64("event_id"), F.lit(salts))
    some = events.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("org_id", "part").orderBy(*newest))).where(F.col("n") <= n)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("org_id").orderBy(*newest))).where(F.col("place") <= n).drop("part", "n")


def candidate_groups(candidates: DataFrame) -> DataFrame:
    """(run_id, review, fallback, blocked, excluded): how many candidates of each kind; a kind of null is review."""
    kind = F.coalesce("candidate_type", F.lit("review_candidate"))
    return candidates.groupBy("run_id").agg(*[F.count_if(kind == f"{k}_candidate").alias(k) for k in ("review", "fallback", "blocked", "excluded")])


def publish_reason(runs: DataFrame) -> DataFrame:
    """(run_id, reason): the first rule that forbids publication, null if none."""
    c = F.col
    reason = (
        F.when((c("status") != "completed") | ~c("completed"), "not_completed").when(c("fallback_used") | (c("validation_status") != "passed"), "unverified")
        .when(~c("has_memo"), "no_memo").when(~c("has_job"), "no_job").when((c("origin") != "public") | (c("visibility") == "private"), "not_public")
        .when(c("history_matches") > 0, "private_history")
    )
    return runs.select("run_id", reason.alias("reason"))


def memo_versions(memos: DataFrame) -> DataFrame:
    """memos(run_id, version) newest first, with the current one marked."""
    place: Column = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("version")))
    return memos.withColumn("place", place).withColumn("current", F.col("place") == 1)


def deletable(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Archived documents(doc_id, archived) without a run that is still queued or running."""
    active = runs.where(F.col("status").isin("queued", "running", "processing")).select("doc_id").distinct()
    return documents.where("archived").join(large(active), "doc_id", "left_anti").select("doc_id")


def open_review_paths(paths: DataFrame) -> DataFrame:
    """Paths(status) that no reviewer has resolved or excluded."""
    return paths.where(~F.col("status").isin("resolved", "excluded_by_reviewer"))


def execution_notice(runs: DataFrame) -> DataFrame:
    """(run_id, notice) of runs(run_id, status, fallback_used, memo_validated, issues): the first rung of the ladder that holds."""
    notice = (
        F.when(F.col("fallback_used"), "fallback_used").when((F.col("status") != "completed") | ~F.col("memo_validated"), "verification_incomplete")
        .when(F.col("issues") > 0, "expert_review_required").otherwise("ready")
    )
    return runs.select("run_id", notice.alias("notice"))


def eligible_state(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, state): review candidates, only others, or none."""
    had = candidates.groupBy("doc_id").agg(F.bool_or(F.coalesce("candidate_type", F.lit("review_candidate")) == "review_candidate").alias("some"))
    return docs.select("doc_id").join(large(had), "doc_id", "left").select("doc_id", F.when(F.col("some"), "eligible_candidates").when(F.col("some").isNotNull(), "blocked_or_unsupported_candidates").otherwise("no_eligible_candidates").alias("state"))


def verified_candidates(candidates: DataFrame, regulations: DataFrame, mapped: DataFrame, cited: DataFrame) -> DataFrame:
    """Candidates(doc_id, code, path_key, paragraph, has_criteria) with a valid code, a current regulation with version and date, a paragraph, criteria, a mapped fact and a citation."""
    current = regulations.where("verification_status = 'current' AND version <> '' AND dated").select("code").distinct()
    rows = candidates.where(is_specific_code(F.col("code")) & (F.coalesce("paragraph", F.lit("")) != "") & F.col("has_criteria")).join(current, "code", "left_semi")
    return rows.join(large(mapped), "doc_id", "left_semi").join(large(cited), "doc_id", "left_semi").select("doc_id", "code", "path_key")

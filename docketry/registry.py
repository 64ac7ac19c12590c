"""The registered queries of the review library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.functions.joins import large
from docketry.operators import decision as dc
from docketry.operators import evidence as ev
from docketry.operators import history as hs
from docketry.operators import profiles as pr
from docketry.operators import review as rw
from docketry.oracles import sql
from docketry.plans.classify import Classified, classify
from docketry.rules import decision as dr
from docketry.rules import review as rv
from docketry.sources import uploads as up
from docketry.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, so that values compare alike in any engine."""
    return df.withColumns({c: F.concat_ws("|", c) for c in columns})


@query("segments", 'SELECT doc_id, ordinal, start, "end", quote FROM segs')
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.segments(views.briefs(spark, sf_dir))


@query("match_terms", "SELECT doc_id, signal, array_to_string(terms, '|') AS terms, quote, start, \"end\" FROM hits")
def match_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.match_terms(ev.segments(views.briefs(spark, sf_dir))), "terms")


@query("source_evidence", "SELECT doc_id, signal, array_to_string(terms, '|') AS terms, quote, start, polarity, scope, evidence_id FROM evidence")
def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.source_evidence(views.briefs(spark, sf_dir)), "terms").select("doc_id", "signal", "terms", "quote", "start", "polarity", "scope", "evidence_id")


@query("effective_polarity", "SELECT * FROM effective")
def effective_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).effective


@query("contradictory_pairs", "SELECT * FROM contradictions")
def contradictory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).contradictions


@query("untrusted_instructions", "SELECT doc_id, pattern FROM briefs, " + "(VALUES " + ", ".join(f"('{p}')" for p in ev.wording.INSTRUCTIONS) + ") AS v(pattern) WHERE regexp_matches(lower(text), pattern)")
def untrusted_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.untrusted(views.briefs(spark, sf_dir))


@query("affirmed_crypto", "SELECT * FROM crypto")
def affirmed_crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ev.affirmed_crypto(views.briefs(spark, sf_dir)), "terms")


@query("score_signals", "SELECT doc_id, signal, contribution, array_to_string(terms, '|') AS terms, array_to_string(quotes, '|') AS quotes, array_to_string(evidence_ids, '|') AS evidence_ids FROM signals")
def score_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(classify(views.briefs(spark, sf_dir)).signals, "terms", "quotes", "evidence_ids")


@query("score_profiles", "SELECT * FROM scores")
def score_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).scores


@query("eligible_profiles", "SELECT doc_id, profile, score, state, positive FROM eligibility")
def eligible_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).eligibility


@query("rank_profiles", "SELECT * FROM ranked")
def rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).ranked


@query("primary_profile", "SELECT doc_id, profile, score FROM ranked WHERE rank = 1")
def primary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).ranked.where("rank = 1").select("doc_id", "profile", "score")


@query("open_paths", "SELECT * FROM paths")
def open_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).paths


@query("missing_evidence", "SELECT * FROM missing")
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).missing


@query("propose_candidates", "SELECT * FROM candidates")
def propose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(views.briefs(spark, sf_dir)).candidates


@query("blocked_families", "SELECT doc_id, path_key, title AS family FROM paths p WHERE path_key <> 'general_electronics_fallback' AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.doc_id = p.doc_id AND c.path_key = p.path_key)")
def blocked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify(views.briefs(spark, sf_dir))
    return pr.blocked_families(c.paths, c.candidates)


@query("profile_confidence", """SELECT doc_id, CASE WHEN n >= 150 THEN 'high' WHEN n >= 110 THEN 'medium' ELSE 'low' END AS level, floor((greatest(n, 40) + 1) / 2) / 100 AS confidence FROM (
    SELECT r.doc_id, least(176, 70 + 5 * score + 5 * least(12, coalesce(s.support, 0)) - 3 * least(6, coalesce(m.n, 0))) AS n FROM ranked r
    LEFT JOIN (SELECT doc_id, count(*) AS support FROM signals GROUP BY doc_id) s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM missing GROUP BY doc_id) m USING (doc_id) WHERE rank = 1)""")  # fmt: skip
def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence_of(classify(views.briefs(spark, sf_dir)))


def confidence_of(c: Classified) -> DataFrame:
    support = c.signals.groupBy("doc_id").agg(F.count("*").alias("support"))
    missing = c.missing.groupBy("doc_id").agg(F.count("*").alias("gaps"))
    rows = c.ranked.where("rank = 1").join(large(support), "doc_id", "left").join(large(missing), "doc_id", "left")
    level, value = pr.confidence(F.col("score"), F.least(F.lit(12), F.coalesce("support", F.lit(0))), F.coalesce("gaps", F.lit(0)))
    return rows.select("doc_id", level.alias("level"), value.alias("confidence"))


@query("mark_duplicates", """SELECT org_id, history_doc_id, sha256(text) AS sha256, nullif(first_value(history_doc_id) OVER (PARTITION BY org_id, sha256(text) ORDER BY created_at, history_doc_id), history_doc_id) AS duplicate_of FROM history""")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.mark_duplicates(views.history_docs(spark, sf_dir)).select("org_id", "history_doc_id", "sha256", "duplicate_of")


@query("batch_status", """SELECT *, CASE WHEN files - completed - failed > 0 THEN CASE WHEN processing > 0 THEN 'processing' ELSE 'queued' END WHEN failed > 0 THEN CASE WHEN completed > 0 THEN 'completed_with_errors' ELSE 'failed' END ELSE 'completed' END AS status FROM (
    SELECT org_id, batch_id, count(*) AS files, count(*) FILTER (ingestion_status = 'queued') AS queued, count(*) FILTER (ingestion_status = 'processing') AS processing, count(*) FILTER (ingestion_status = 'indexed') AS indexed,
    count(*) FILTER (ingestion_status = 'failed') AS failed, count(*) FILTER (ingestion_status = 'duplicate') AS duplicate, count(*) FILTER (ingestion_status IN ('indexed', 'duplicate')) AS completed FROM history GROUP BY org_id, batch_id)""")  # fmt: skip
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.batch_status(views.history_docs(spark, sf_dir))


@query("workspace_counts", "SELECT org_id, count(*) AS documents, count(*) FILTER (ingestion_status = 'indexed') AS indexed, count(*) FILTER (ingestion_status = 'failed') AS failed, count(DISTINCT sha256(text)) AS contents FROM history GROUP BY org_id")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.workspace_counts(views.history_docs(spark, sf_dir))


_CHUNKS = f"""WITH RECURSIVE body AS (SELECT history_doc_id, trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM ({views.HISTORY_DOCS})),
  bound AS (SELECT history_doc_id, t, 0 AS ordinal, 0 AS s, {{stop0}} AS e FROM body WHERE length(t) > 0
    UNION ALL SELECT history_doc_id, t, ordinal + 1, n, {{stopn}} FROM (SELECT *, greatest(e - {rv.CHUNK_OVERLAP}, s + 1) AS n FROM bound WHERE e < length(t)))
  SELECT history_doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(s AS INTEGER) AS char_start, CAST(s + length(c) AS INTEGER) AS char_end, c AS content, sha256(c) AS content_hash
    FROM (SELECT *, trim(substr(t, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM bound) WHERE c <> ''"""  # fmt: skip


def _stop(s: str) -> str:
    back = f"strpos(reverse(substr(t, {s} + {rv.CHUNK_LEAST + 2}, {rv.CHUNK_SIZE - rv.CHUNK_LEAST})), chr(10))"
    return f"CASE WHEN {s} + {rv.CHUNK_SIZE} >= length(t) THEN length(t) WHEN {back} > 0 THEN {s} + {rv.CHUNK_SIZE + 1} - {back} ELSE {s} + {rv.CHUNK_SIZE} END"


@query("chunk_text", _CHUNKS.format(stop0=_stop("0"), stopn=_stop("n")))
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.chunk_text(views.history_docs(spark, sf_dir))


_SEARCH = f"""SELECT * FROM (SELECT org_id, query_id, chunk_id, matches, matches / 10 AS score, CAST(row_number() OVER (PARTITION BY org_id, query_id ORDER BY matches DESC, created_at DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT q.org_id, query_id, chunk_id, created_at, CAST(count(*) AS BIGINT) AS matches FROM
      (SELECT DISTINCT org_id, query_id, token FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_) AS place FROM (
        SELECT *, min(i) OVER (PARTITION BY query_id, token) AS first_ FROM (SELECT org_id, history_doc_id AS query_id, unnest(range(len(t))) AS i, lower(unnest(t)) AS token FROM
          (SELECT *, regexp_extract_all(text, '{rv.TOKEN}') AS t FROM history WHERE history_doc_id % 100 = 0)) WHERE token NOT IN ({", ".join(f"'{w}'" for w in rv.STOP_WORDS)}))) WHERE place <= {rv.QUERY_TERMS}) q
      JOIN (SELECT org_id, history_doc_id AS chunk_id, created_at, lower(unnest(regexp_extract_all(text, '{rv.TOKEN}'))) AS token FROM history) h ON q.org_id = h.org_id AND q.token = h.token
    GROUP BY q.org_id, query_id, chunk_id, created_at)) WHERE rank <= {rv.MATCHES}"""  # fmt: skip


@query("search_lexical", _SEARCH)
def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.history_docs(spark, sf_dir)
    asked = hs.query_terms(docs.where("history_doc_id % 100 = 0").withColumnRenamed("history_doc_id", "query_id"))
    return hs.search_lexical(asked, docs.withColumnRenamed("history_doc_id", "chunk_id"))


_EVENTS = """SELECT CAST(o_custkey AS BIGINT) AS run_id, CAST(o_orderkey AS BIGINT) AS seq,
  CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'needs_attention' ELSE 'unknown' END AS status FROM orders"""


@query("check_transitions", f"""SELECT run_id, seq, f AS from_status, status AS to_status, coalesce((f, status) IN ({", ".join(f"('{a}', '{b}')" for a, b in rv.TRANSITIONS)}), false) AS allowed
    FROM (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS f FROM ({_EVENTS})) WHERE f IS NOT NULL""")  # fmt: skip
def check_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "orders")
    return rw.check_transitions(spark.sql(_EVENTS))


@query("review_queue", """SELECT org_id, run_id, workflow_state, updated_at, CAST(row_number() OVER (PARTITION BY org_id ORDER BY updated_at, run_id) AS INTEGER) AS place FROM runs
    WHERE NOT archived AND requires_human_review AND workflow_state IN ('pending_review', 'in_review', 'needs_information', 'escalated', 'in_technical_review')""")  # fmt: skip
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.review_queue(views.runs(spark, sf_dir))


_REVIEWS = """SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS review_id, l_shipdate AS created_at, l_linenumber % 2 = 0 AS claimed,
  CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'reviewed' WHEN 3 THEN 'rejected' ELSE 'needs_more_information' END AS status FROM lineitem"""
_LATEST = f"SELECT run_id, review_id, status, claimed, created_at FROM ({_REVIEWS}) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, review_id DESC) = 1"


@query("latest_review", _LATEST)
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return rw.latest_review(spark.sql(_REVIEWS))


@query("review_label", f"""SELECT r.run_id, CASE WHEN NOT requires_human_review THEN 'not_requested' WHEN l.status IS NULL OR l.status = 'pending_review' THEN CASE WHEN claimed THEN 'under_review' ELSE 'review_required' END
    WHEN l.status = 'needs_more_information' THEN 'review_required' ELSE l.status END AS code FROM runs r LEFT JOIN ({_LATEST}) l ON r.run_id = l.run_id""")  # fmt: skip
def review_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return rw.review_label(views.runs(spark, sf_dir), rw.latest_review(spark.sql(_REVIEWS)))


_ACTIONS = """SELECT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS seq,
  CASE (l_orderkey + 3 * l_linenumber) % 7 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_more_information' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'pending_review' ELSE 'comment' END AS action FROM lineitem"""


@query("workflow_state", f"""SELECT run_id, seq, last_value(s IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS workflow_state
    FROM (SELECT *, CASE action {" ".join(f"WHEN '{a}' THEN '{s}'" for a, s in rv.WORKFLOW)} END AS s FROM ({_ACTIONS}))""")  # fmt: skip
def workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return rw.workflow_state(spark.sql(_ACTIONS))


_AUDIT = "SELECT 'org' || CAST(user_id % 7 AS VARCHAR(4)) AS org_id, CAST(event_id AS BIGINT) AS event_id, ts AS created_at, event_type AS action FROM events"


@query("audit_log", f"SELECT org_id, event_id, action, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, event_id DESC) AS place FROM ({_AUDIT})) WHERE place <= 100")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "events")
    return rw.audit_log(spark.sql(_AUDIT)).select("org_id", "event_id", "action", "place")


@query("candidate_groups", "SELECT doc_id AS run_id, count(*) FILTER (candidate_type = 'review_candidate') AS review, CAST(0 AS BIGINT) AS fallback, count(*) FILTER (candidate_type = 'blocked_candidate') AS blocked, CAST(0 AS BIGINT) AS excluded FROM candidates GROUP BY doc_id")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.candidate_groups(classify(views.briefs(spark, sf_dir)).candidates.withColumnRenamed("doc_id", "run_id"))


_FILES = "SELECT CAST(l_suppkey * 1000 + l_partkey % 37 AS BIGINT) AS batch_id, CAST(l_quantity * 150000 AS BIGINT) AS size_bytes FROM lineitem"


@query("check_batches", f"""SELECT batch_id, files, total_bytes, CASE WHEN files = 0 THEN 'no_files' WHEN files > 20 THEN 'too_many_files' WHEN total_bytes > 52428800 THEN 'batch_too_large' WHEN largest > 8388608 THEN 'file_too_large' ELSE 'ok' END AS verdict
    FROM (SELECT batch_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, max(size_bytes) AS largest FROM ({_FILES}) GROUP BY batch_id)""")  # fmt: skip
def check_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return up.check_batches(spark.sql(_FILES))


_LIMITED = """WITH RECURSIVE numbered AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
  walked AS (SELECT key, ts, i, ts AS since, 1 AS n, true AS allowed, 0 AS retry_seconds FROM numbered WHERE i = 1
    UNION ALL SELECT w.key, e.ts, e.i, CASE WHEN e.ts >= since + 3600 THEN e.ts ELSE since END, CASE WHEN e.ts >= since + 3600 THEN 1 WHEN n >= 3 THEN n ELSE n + 1 END, e.ts >= since + 3600 OR n < 3,
      CASE WHEN e.ts >= since + 3600 OR n < 3 THEN 0 ELSE CAST(greatest(1, ceil(since + 3600 - e.ts)) AS INTEGER) END FROM walked w JOIN numbered e ON e.key = w.key AND e.i = w.i + 1)
  SELECT key, ts, allowed, retry_seconds, false AS late FROM walked"""


@query("rate_limit", _LIMITED)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "events")
    return jobs.rate_limit(spark.sql("SELECT CAST(user_id AS STRING) AS key, unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS ts FROM events"), 3, 3600.0)


_FORM = "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{f}'" for f, p in dr.FORMS) + " ELSE 'unknown' END AS form FROM briefs"
_CANON = "(VALUES " + ", ".join(f"('{k}', '{s}')" for k, _, ss, _ in dr.CANONICAL for s in ss) + ") AS v(path_key, signal)"
_NEED = "(VALUES " + ", ".join(f"('{k}', '{r}')" for k, _, _, rs in dr.CANONICAL for r in rs) + ") AS v(path_key, requirement)"
_FORM_NEED = "(VALUES " + ", ".join(f"('{f}', '{r}')" for f, rs in dr.FORM_REQUIREMENTS for r in rs) + ") AS v(form, requirement)"
_WORDS = "(VALUES " + ", ".join(f"('{r}', '{k}')" for r, ks in dr.KEYWORDS for k in ks) + ") AS v(requirement, word)"
_DIRECT = f"SELECT doc_id, path_key, evidence_id, polarity FROM evidence JOIN {_CANON} USING (signal) WHERE polarity IN ('present', 'ambiguous')"
_PATHS = f"""SELECT doc_id, path_key, count(DISTINCT evidence_id) AS triggers, CASE WHEN bool_and(polarity = 'ambiguous') THEN 'configuration_dependent' ELSE 'direct_positive' END AS trigger_type FROM (
    {_DIRECT} UNION ALL SELECT doc_id, 'sensor_industrial', evidence_id, polarity FROM evidence JOIN ({_FORM}) f USING (doc_id) WHERE form = 'gateway' AND contains(lower(quote), 'gateway')
    AND doc_id NOT IN (SELECT doc_id FROM ({_DIRECT}) WHERE path_key = 'sensor_industrial')) GROUP BY doc_id, path_key"""
_REQUIREMENTS = f"""SELECT a.doc_id, path_key, a.requirement, m.doc_id IS NOT NULL AS satisfied FROM (
      SELECT doc_id, path_key, requirement FROM ({_PATHS}) JOIN {_NEED} USING (path_key) UNION SELECT doc_id, path_key, requirement FROM ({_PATHS}) JOIN ({_FORM}) f USING (doc_id) JOIN {_FORM_NEED} USING (form)) a
    LEFT JOIN (SELECT DISTINCT doc_id, requirement FROM evidence JOIN {_WORDS} ON contains(lower(quote), word) WHERE polarity = 'present') m ON a.doc_id = m.doc_id AND a.requirement = m.requirement"""
_REGULATIONS = "SELECT 'x' AS code, 'current' AS verification_status UNION ALL SELECT '3A001', 'current' UNION ALL SELECT '5A002', 'current' UNION ALL SELECT '5A991', 'needs_verification'"


@query("product_form", _FORM)
def product_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.product_form(views.briefs(spark, sf_dir))


@query("resolve_profile", f"""SELECT doc_id, form, coalesce(p, profile) AS profile, coalesce(p <> profile, false) AS overridden FROM (SELECT *, CASE form {" ".join(f"WHEN '{f}' THEN '{p}'" for f, p in dr.FORM_PROFILES)} END AS p FROM ({_FORM}))
    JOIN ranked USING (doc_id) WHERE rank = 1""")  # fmt: skip
def resolve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    return dc.resolve_profile(dc.product_form(docs), classify(docs).ranked)


@query("capabilities", """SELECT doc_id, signal, CASE WHEN bool_or(polarity = 'present') THEN 'present' WHEN bool_or(polarity = 'ambiguous') THEN 'configuration_dependent' WHEN bool_or(polarity = 'absent') THEN 'absent' ELSE 'unknown' END AS presence
    FROM evidence GROUP BY doc_id, signal""")  # fmt: skip
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.capabilities(ev.source_evidence(views.briefs(spark, sf_dir)))


@query("canonical_paths", _PATHS)
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    return dc.canonical_paths(ev.source_evidence(docs), dc.product_form(docs))


@query("provenance_edges", f"SELECT DISTINCT doc_id, evidence_id, path_key FROM ({_DIRECT})")
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.provenance_edges(ev.source_evidence(views.briefs(spark, sf_dir)))


@query("assess_requirements", _REQUIREMENTS)
def assess_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    evidence, forms = ev.source_evidence(docs), dc.product_form(docs)
    return dc.assess_requirements(dc.canonical_paths(evidence, forms), forms, evidence)


GATE = f"""SELECT c.doc_id, c.code, c.k AS path_key, CASE WHEN p.doc_id IS NULL THEN 'rejected' WHEN g.code IS NULL OR coalesce(n, 0) > 0 THEN 'blocked' ELSE 'eligible' END AS status,
      concat_ws('|', CASE WHEN p.doc_id IS NULL THEN 'review_path_not_open|no_positive_path_trigger_evidence' END, CASE WHEN g.code IS NULL THEN 'current_regulatory_text_unavailable' END, u.unmet) AS reasons
    FROM (SELECT *, CASE path_key {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dr.ALIASES)} ELSE path_key END AS k FROM candidates) c
    LEFT JOIN ({_PATHS}) p ON p.doc_id = c.doc_id AND p.path_key = c.k LEFT JOIN (SELECT doc_id, path_key, count(*) AS n, string_agg(DISTINCT replace(requirement, ' ', '_') || '_unknown', '|' ORDER BY replace(requirement, ' ', '_') || '_unknown') AS unmet
      FROM ({_REQUIREMENTS}) WHERE NOT satisfied GROUP BY doc_id, path_key) u ON u.doc_id = c.doc_id AND u.path_key = c.k
    LEFT JOIN ({_REGULATIONS}) g ON g.code = c.code AND g.verification_status = 'current'"""  # fmt: skip


@query("gate_candidates", GATE)
def gate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    c, forms = classify(docs), dc.product_form(docs)
    paths = dc.canonical_paths(c.evidence, forms)
    return joined(dc.gate_candidates(c.candidates, paths, dc.assess_requirements(paths, forms, c.evidence), spark.sql(_REGULATIONS)), "reasons")


# the other query modules register theirs on import
from docketry import registry_backfill, registry_checks, registry_facts, registry_history, registry_identity, registry_intake, registry_outputs, registry_prior, registry_records, registry_rollup  # noqa: E402, F401

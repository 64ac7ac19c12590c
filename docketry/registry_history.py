"""Registered queries of retrieval, uploads and review that registry.py doesn't hold, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.functions import text as tx
from docketry.functions.joins import large
from docketry.operators import decision as dc
from docketry.operators import evaluate as evl
from docketry.operators import evidence as ev
from docketry.operators import history as hs
from docketry.operators import retrieval as rt
from docketry.operators import review as rw
from docketry.oracles import STEPS, text
from docketry.plans.classify import classify
from docketry.registry import _REGULATIONS, GATE, ORACLES, joined, query
from docketry.rules import history as hr
from docketry.rules import review as rv
from docketry.sources import uploads as up


def _polarity(column: str, pattern: str) -> str:
    parts = f"[s for s in string_split(regexp_replace({column}, '([.!?])[ \\t\\n]+', '\\1' || chr(10), 'g'), chr(10)) if regexp_matches(s, {text('(?i)' + pattern)})]"
    denied = f"[s for s in {parts} if regexp_matches(s, {text('(?i)' + hr.ABSENT)})]"
    return f"CASE WHEN len({parts}) = 0 THEN 'unknown' WHEN len({denied}) = len({parts}) THEN 'absent' WHEN len({denied}) > 0 THEN 'ambiguous' ELSE 'present' END"


def _polarities(column: str) -> str:
    return "[" + ", ".join(_polarity(column, p) for _, p in hr.CONCEPTS) + "]"


_WHOLE, _HEADING = "lower(concat_ws(chr(10), file_name, title, content))", "lower(concat_ws(chr(10), file_name, title))"
_ROLE = (
    f"CASE WHEN regexp_matches({_WHOLE}, '\\breadme\\b') THEN 'dataset_readme' " + " ".join(f"WHEN record_type = {text(a)} THEN {text(b)}" for a, b in hr.TYPE_ROLES)
    + f" WHEN regexp_matches(file_name, '(?i)\\.(?:csv|json)$') OR (regexp_matches(content, {text(hr.RECORD_START)}) AND regexp_matches(content, {text(hr.RECORD_FIELD)})) THEN 'product_precedent' "
    + " ".join(f"WHEN regexp_matches({_HEADING if where == 'heading' else _WHOLE}, {text('(?i)' + p)}) THEN {text(role)}" for role, where, p in hr.ROLE_WORDING) + " ELSE 'unclassified' END"
)
_STOP = ", ".join(text(w) for w in rv.STOP_WORDS)


def _has(items: str) -> str:
    return f"len([x for x in string_split({items}, '|') if length(x) >= 3 AND contains(hay, lower(x))])"


_COUNT = "len([i for i in range(1, " + str(len(hr.CONCEPTS) + 1) + ") if {0}])"
STEPS.update({
    "records": views.RECORDS,
    "asked": views.ASKED,
    "live_versions": "SELECT org_id, history_doc_id, max(ingestion_version) AS chunk_version FROM records WHERE ingestion_status = 'indexed' GROUP BY org_id, history_doc_id",
    "live_chunks": "SELECT r.* FROM records r JOIN live_versions USING (org_id, history_doc_id, chunk_version)",
    "asked_terms": f"""SELECT DISTINCT org_id, query_id, token FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_) AS place FROM (SELECT *, min(i) OVER (PARTITION BY query_id, token) AS first_ FROM (
        SELECT org_id, query_id, unnest(range(len(t))) AS i, lower(unnest(t)) AS token FROM (SELECT *, regexp_extract_all(text, '{rv.TOKEN}') AS t FROM asked)) WHERE token NOT IN ({_STOP}))) WHERE place <= {rv.QUERY_TERMS}""",
    "lexical_hits": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, query_id ORDER BY n DESC, created_at DESC, chunk_id) AS place FROM (SELECT q.org_id, query_id, chunk_id, created_at, count(*) AS n FROM asked_terms q
        JOIN (SELECT org_id, chunk_id, created_at, lower(unnest(regexp_extract_all(content, '{rv.TOKEN}'))) AS token FROM live_chunks) h ON h.org_id = q.org_id AND h.token = q.token GROUP BY q.org_id, query_id, chunk_id, created_at)) WHERE place <= {rv.MATCHES}""",
    "told": f"SELECT org_id, chunk_id, lower(concat_ws(chr(10), title, file_name, content)) AS hay, {_ROLE} AS role, {_polarities('lower(concat_ws(chr(10), title, file_name, content))')} AS hp FROM live_chunks",
    "told_pairs": f"""SELECT l.org_id, query_id, chunk_id, n / CAST(10 AS DOUBLE) AS base, role, {_has('identifiers')} AS n_ids, {_has('families')} AS n_families, {_has('facts')} AS n_facts,
        {_COUNT.format("cp[i] = 'present' AND hp[i] = 'present'")} AS shared, {_COUNT.format("cp[i] = 'absent' AND hp[i] = 'present'")} AS blocked,
        {_COUNT.format("cp[i] <> 'unknown' AND hp[i] <> 'unknown' AND cp[i] <> hp[i] AND NOT (cp[i] = 'absent' AND hp[i] = 'present')")} AS apart,
        (regexp_matches(text, {text('(?i)' + hr.NETWORKING)}) AND regexp_matches(hay, {text('(?i)' + hr.ACCELERATOR)})) OR (regexp_matches(text, {text('(?i)' + hr.ACCELERATOR)}) AND regexp_matches(hay, {text('(?i)' + hr.NETWORKING)})) AS other_form
        FROM lexical_hits l JOIN (SELECT query_id, text, identifiers, families, facts, {_polarities('text')} AS cp FROM asked) USING (query_id) JOIN told USING (org_id, chunk_id)""",
    "weighed": """SELECT *, CASE WHEN n_ids > 0 THEN 'direct' WHEN n_facts >= 2 OR n_families > 0 THEN 'partial' ELSE 'weak' END AS plain_tier, CAST(CASE WHEN other_form THEN 10 ELSE 0 END + 12 * blocked + 4 * apart AS INTEGER) AS penalty,
        CASE WHEN n_ids > 0 THEN 6 + n_ids ELSE 0 END + CASE WHEN n_families > 0 THEN 3 ELSE 0 END + least(CAST(3 AS DOUBLE), n_facts * CAST(0.75 AS DOUBLE)) + least(CAST(3.5 AS DOUBLE), shared * CAST(0.65 AS DOUBLE)) AS boost FROM told_pairs""",
    "scored_matches": f"""SELECT org_id, query_id, chunk_id, round(base + boost - penalty, 4) AS score, CASE WHEN blocked > 0 THEN 'weak' ELSE plain_tier END AS tier,
        CASE WHEN role NOT IN ({", ".join(text(r) for r in hr.PRODUCT_ROLES)}) THEN CASE WHEN role IN ('dataset_readme', 'administrative') THEN 'irrelevant' ELSE 'context' END WHEN blocked > 0 OR penalty >= 10 THEN 'contrast'
        WHEN plain_tier = 'direct' THEN 'precedent' WHEN plain_tier = 'partial' OR shared > 0 THEN 'partial_precedent' ELSE 'irrelevant' END AS use, role, penalty FROM weighed""",
    "best_matches": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT s.*, history_doc_id AS document_id, row_number() OVER (PARTITION BY query_id, history_doc_id ORDER BY score DESC, s.chunk_id) AS k
        FROM scored_matches s JOIN records r ON r.chunk_id = s.chunk_id) WHERE k = 1""",
    "in_pools": """SELECT *, CASE WHEN role IN ('product_precedent', 'classification_memo', 'review_worksheet') AND use IN ('precedent', 'partial_precedent', 'contrast') THEN 'product_precedents' WHEN role = 'technical_source' AND use <> 'irrelevant' THEN 'technical_comparisons'
        WHEN role = 'counsel_guidance' THEN 'counsel_guidance' WHEN role = 'internal_policy' THEN 'internal_policy' WHEN role = 'regulatory_material' THEN 'regulatory_context' WHEN role IN ('dataset_readme', 'administrative', 'unclassified') OR use = 'irrelevant' THEN 'excluded' END AS pool FROM best_matches""",
    "located": f"SELECT chunk_id, record_type = 'spreadsheet' OR regexp_matches(file_name, '(?i)\\.csv$') AS is_row, chunk_ordinal, trim(regexp_extract(content, {text(hr.RECORD_ID)}, 1)) AS record_id, content FROM records",
})


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    return rt.current_chunks(rows, rows)


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked, live = views.asked(spark, sf_dir), _live(spark, sf_dir)
    return asked, live, hs.search_alike(hs.query_terms(asked), live.withColumnRenamed("content", "text"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, live, hits = _hits(spark, sf_dir)
    lists = asked.select("query_id", "text", *[F.split(c, r"\|").alias(c) for c in ("identifiers", "families", "facts")])
    return rt.score_matches(hits.select("org_id", "query_id", "chunk_id", "score"), lists, live)


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = views.records(spark, sf_dir).select("chunk_id", F.col("history_doc_id").alias("document_id"))
    return hs.best_per_document(_scored(spark, sf_dir).join(large(of), "chunk_id"))


@query("current_chunks", "SELECT org_id, history_doc_id, chunk_id, chunk_version FROM live_chunks")
def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("org_id", "history_doc_id", "chunk_id", "chunk_version")


@query("capability_polarity", "SELECT chunk_id, array_to_string(" + _polarities("content") + ", '|') AS polarity FROM records")
def capability_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(views.records(spark, sf_dir).select("chunk_id", rt.polarities(F.col("content")).alias("polarity")), "polarity")


@query("record_role", f"SELECT chunk_id, {_ROLE} AS role FROM records")
def record_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.records(spark, sf_dir).select("chunk_id", rt.record_role(F.col("file_name"), F.col("title"), F.col("content"), F.col("record_type")).alias("role"))


@query("score_matches", "SELECT * FROM scored_matches")
def score_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query("best_per_document", "SELECT query_id, document_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM best_matches")
def best_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("query_id", "document_id", "chunk_id", "score", "rank")


@query("role_pools", f"SELECT query_id, pool, chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pool ORDER BY rank) AS place FROM in_pools WHERE pool IS NOT NULL) WHERE place <= {rv.POOL} OR pool = 'excluded'")
def role_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.role_pools(rt.pooled(_best(spark, sf_dir)).where("pool IS NOT NULL")).select("query_id", "pool", "chunk_id", "place")


_NONE = "SELECT query_id, org_id, 'zz' || CAST(query_id AS VARCHAR(12)) || '|memo|switch' AS words FROM {a}"


@query("search_keyword", f"""SELECT * FROM (SELECT r.org_id, query_id, chunk_id, CAST(row_number() OVER (PARTITION BY r.org_id, query_id ORDER BY created_at DESC, chunk_id) AS INTEGER) AS rank FROM ({_NONE.format(a='asked')}) q JOIN live_chunks r ON r.org_id = q.org_id
    AND len([t for t in string_split(words, '|') if contains(lower(concat_ws(chr(10), title, file_name, content)), t)]) > 0) WHERE rank <= {rv.MATCHES}""")  # fmt: skip
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(_NONE, a=views.asked(spark, sf_dir)).select("org_id", "query_id", F.split("words", r"\|").alias("terms"))
    return rt.search_keyword(asked, _live(spark, sf_dir))


@query("locate_record", "SELECT chunk_id, is_row, CASE WHEN is_row THEN 'CSV row ' || (chunk_ordinal + 2) ELSE 'record ' || (chunk_ordinal + 1) END AS locator, record_id FROM located")
def locate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.locate_record(views.records(spark, sf_dir)).drop("content")


#: Every fifth match is put into a pool that may not take its role.
_MISPLACED = "SELECT query_id, chunk_id, role, CASE WHEN chunk_id % 5 = 0 THEN 'internal_policy' ELSE pool END AS pool FROM {m} WHERE pool IS NOT NULL"


@query("check_projection", f"""SELECT query_id, chunk_id, 'HISTORY_ROLE_SECTION_MISMATCH' AS code FROM ({_MISPLACED.format(m='in_pools')}) WHERE pool IN ('product_precedents', 'technical_comparisons', 'counsel_guidance', 'internal_policy')
    AND NOT (pool = 'product_precedents' AND role IN ('product_precedent', 'classification_memo', 'review_worksheet') OR pool = 'technical_comparisons' AND role IN ('technical_source', 'classification_memo', 'product_precedent', 'review_worksheet') OR pool = role AND pool IN ('counsel_guidance', 'internal_policy'))
    UNION ALL SELECT query_id, chunk_id, 'STRUCTURED_HISTORY_RECORD_LEAKAGE' FROM ({_MISPLACED.format(m='in_pools')}) JOIN located USING (chunk_id) WHERE is_row AND len(regexp_extract_all(content, {text(hr.RECORD_IDS)})) > 1 AND pool IN ('product_precedents', 'technical_comparisons', 'counsel_guidance', 'internal_policy')""")  # fmt: skip
def check_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = spark.sql(_MISPLACED, m=rt.pooled(_best(spark, sf_dir)))
    return rt.check_projection(matches, rt.locate_record(views.records(spark, sf_dir)))


@query("history_signals", f"SELECT query_id, chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(concat_ws(' ', title, file_name, content), {text(hr.HISTORY_CODE)}))), '|') AS codes FROM scored_matches JOIN live_chunks USING (org_id, chunk_id)")
def history_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(rt.history_signals(_scored(spark, sf_dir), _live(spark, sf_dir)), "codes")


@query("retrieval_trace", f"""SELECT query_id, coalesce(b, 0) AS chunks_before, coalesce(c, 0) AS candidates, coalesce(t, '') AS top FROM asked LEFT JOIN (SELECT org_id, count(*) AS b FROM live_chunks GROUP BY org_id) USING (org_id)
    LEFT JOIN (SELECT query_id, count(*) AS c, string_agg(chunk_id, '|' ORDER BY k) FILTER (k <= {hr.TRACE}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM scored_matches) GROUP BY query_id) USING (query_id)""")  # fmt: skip
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, live, _ = _hits(spark, sf_dir)
    return joined(rt.retrieval_trace(asked, live, _scored(spark, sf_dir)), "top")


@query("history_detail", "SELECT org_id, history_doc_id, CAST(place AS INTEGER) AS place, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, history_doc_id ORDER BY chunk_version DESC, chunk_ordinal, chunk_id) AS place FROM records) WHERE place <= 20")
def history_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.records(spark, sf_dir)
    return rt.history_detail(rows, rows)


_UPLOADS = """SELECT CAST(p_partkey AS BIGINT) AS file_id, CASE p_partkey % 4 WHEN 0 THEN 'Data sheet' ELSE '..a b' END || CASE p_partkey % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.exe' WHEN 3 THEN '.csv' WHEN 4 THEN '.json' ELSE '.md' END AS file_name,
  CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/csv' ELSE 'image/png' END AS mime_type,
  CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '%PDF-1.7 ' || p_name ELSE p_name END AS body FROM part"""
_EXT = "lower(regexp_extract(file_name, '\\.([^.]+)$', 1))"


@query("check_uploads", f"""SELECT file_id, CASE WHEN body = '' THEN 'empty' WHEN NOT ({_EXT} IN ({", ".join(text(e) for e in rv.EXTENSIONS)}) AND mime_type IN ({", ".join(text(m) for m in rv.MIME_TYPES)})) THEN 'unsupported_type'
    WHEN {_EXT} = 'pdf' AND (mime_type <> 'application/pdf' OR substr(body, 1, 5) <> '%PDF-') THEN 'bad_signature' WHEN {_EXT} <> 'pdf' AND NOT (starts_with(mime_type, 'text/') OR mime_type = 'application/json') THEN 'not_text' ELSE 'ok' END AS verdict FROM ({_UPLOADS})""")  # fmt: skip
def check_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return up.check_uploads(spark.sql(_UPLOADS).withColumn("content", F.encode("body", "UTF-8"))).select("file_id", "verdict")


_SAFE = "substr(regexp_replace(regexp_replace(regexp_replace(file_name, '[^a-zA-Z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^[.-]+', ''), 1, 180)"


@query("content_key", f"SELECT file_id, CASE WHEN {_SAFE} = '' THEN 'upload.bin' ELSE {_SAFE} END AS safe_name, sha256(body) AS sha256 FROM ({_UPLOADS})")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return up.content_key(spark.sql(_UPLOADS).withColumn("content", F.encode("body", "UTF-8"))).select("file_id", "safe_name", "sha256")


@query("find_codes", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[0-9][A-Z][0-9]{3}(?:\\.[A-Za-z0-9]+|[A-Za-z0-9]*)?\\b'))), '|') AS codes, regexp_full_match(substr(text, -6, 5), '[0-9][A-Z][0-9]{3}(?:\\.[A-Za-z0-9]+|[A-Za-z0-9]*)?') AS is_code FROM briefs")
def find_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(views.briefs(spark, sf_dir).select("doc_id", tx.find_codes(F.col("text")).alias("codes"), tx.is_specific_code(F.substring("text", -6, 5)).alias("is_code")), "codes")


_MODES = "SELECT run_id, CASE run_id % 5 WHEN 0 THEN 'heuristic_fallback' ELSE 'ai' END AS mode, CASE run_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'failed' ELSE 'completed' END AS backend_status FROM {runs}"
_SEVERE = "SELECT CAST(l_orderkey AS BIGINT) AS run_id, CASE l_linenumber % 5 WHEN 0 THEN 'error' ELSE 'warning' END AS severity FROM lineitem WHERE l_quantity > 45"


@query("completion_status", f"""SELECT run_id, mode = 'heuristic_fallback' AS fallback_used, CASE WHEN backend_status = 'unknown' THEN 'unknown' WHEN backend_status <> 'completed' OR mode = 'heuristic_fallback' OR coalesce(e, false) THEN 'needs_attention' ELSE 'completed' END AS status,
    CASE WHEN coalesce(e, false) THEN 'failed' WHEN mode = 'heuristic_fallback' OR coalesce(n, 0) > 0 THEN 'warnings' ELSE 'passed' END AS validation_status FROM ({_MODES.format(runs='runs')}) LEFT JOIN (SELECT run_id, bool_or(severity = 'error') AS e, count(*) AS n FROM ({_SEVERE}) GROUP BY run_id) USING (run_id)""")  # fmt: skip
def completion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return rw.completion_status(spark.sql(_MODES, runs=views.runs(spark, sf_dir)), spark.sql(_SEVERE))


@query("list_runs", "SELECT run_id, 'active' AS lifecycle FROM runs WHERE NOT archived UNION ALL SELECT run_id, 'archived' FROM runs WHERE archived")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark, sf_dir)
    return rw.list_runs(runs, "active").select("run_id", F.lit("active").alias("lifecycle")).unionByName(rw.list_runs(runs, "archived").select("run_id", F.lit("archived").alias("lifecycle")))


@query("memo_versions", "SELECT run_id, version, CAST(row_number() OVER (PARTITION BY run_id ORDER BY version DESC) AS INTEGER) AS place, version = max(version) OVER (PARTITION BY run_id) AS current FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS version FROM lineitem)")
def memo_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "lineitem")
    return rw.memo_versions(spark.sql("SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS run_id, CAST(l_linenumber AS BIGINT) AS version FROM lineitem"))


_PUBLISH = "SELECT run_id, status, status = 'completed' AND run_id % 21 <> 0 AS completed, fallback_used, validation_status, run_id % 5 <> 0 AS has_memo, run_id % 11 <> 0 AS has_job, CASE WHEN run_id % 4 = 0 THEN 'private' ELSE 'public' END AS origin, CASE WHEN run_id % 13 = 0 THEN 'private' ELSE 'shared' END AS visibility, run_id % 17 AS history_matches FROM {runs}"


@query("publish_eligibility", f"""SELECT run_id, CASE WHEN status <> 'completed' OR NOT completed THEN 'not_completed' WHEN fallback_used OR validation_status <> 'passed' THEN 'unverified' WHEN NOT has_memo THEN 'no_memo' WHEN NOT has_job THEN 'no_job' WHEN origin <> 'public' OR visibility = 'private' THEN 'not_public'
    WHEN history_matches > 0 THEN 'private_history' END AS reason FROM ({_PUBLISH.format(runs='runs')})""")  # fmt: skip
def publish_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.publish_reason(spark.sql(_PUBLISH, runs=views.runs(spark, sf_dir)))


_CUSTOMERS = "SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_custkey % 3 = 0 AS archived FROM customer"


@query("deletable", f"SELECT doc_id FROM ({_CUSTOMERS}) WHERE archived AND doc_id NOT IN (SELECT doc_id FROM runs WHERE status IN ('queued', 'running', 'processing'))")
def deletable(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "customer")
    return rw.deletable(spark.sql(_CUSTOMERS), views.runs(spark, sf_dir))


@query("execution_notice", """SELECT run_id, CASE WHEN fallback_used THEN 'fallback_used' WHEN status <> 'completed' OR run_id % 5 = 0 THEN 'verification_incomplete' WHEN run_id % 4 = 0 THEN 'expert_review_required' ELSE 'ready' END AS notice FROM runs""")
def execution_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.runs(spark, sf_dir)
    return rw.execution_notice(runs.select("run_id", "status", "fallback_used", (F.col("run_id") % 5 != 0).alias("memo_validated"), F.when(F.col("run_id") % 4 == 0, 1).otherwise(0).alias("issues")))


@query("open_review_paths", "SELECT doc_id, path_key FROM paths WHERE (doc_id + ordinal) % 3 = 0")
def open_review_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = classify(views.briefs(spark, sf_dir)).paths
    state = F.when((F.col("doc_id") + F.col("ordinal")) % 3 == 0, "open").when((F.col("doc_id") + F.col("ordinal")) % 3 == 1, "resolved").otherwise("excluded_by_reviewer")
    return rw.open_review_paths(paths.withColumn("status", state)).select("doc_id", "path_key")


@query("eligible_state", "SELECT doc_id, CASE WHEN count(*) FILTER (candidate_type = 'review_candidate') > 0 THEN 'eligible_candidates' WHEN count(candidate_type) > 0 THEN 'blocked_or_unsupported_candidates' ELSE 'no_eligible_candidates' END AS state FROM briefs LEFT JOIN candidates USING (doc_id) GROUP BY doc_id")
def eligible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    return rw.eligible_state(docs, classify(docs).candidates)


@query("specific_candidates", "SELECT doc_id, code, path_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code, path_key ORDER BY ordinal) AS n FROM (SELECT * FROM candidates UNION ALL SELECT doc_id, ordinal + 100, code, candidate_type, path_key FROM candidates UNION ALL SELECT doc_id, ordinal + 200, 'EAR99', candidate_type, path_key FROM candidates)) WHERE n = 1 AND regexp_full_match(code, '[0-9][A-Z][0-9]{3}(?:\\.[A-Za-z0-9]+|[A-Za-z0-9]*)?')")
def specific_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify(views.briefs(spark, sf_dir)).candidates
    more = c.unionByName(c.withColumn("ordinal", F.col("ordinal") + 100)).unionByName(c.withColumn("ordinal", F.col("ordinal") + 200).withColumn("code", F.lit("EAR99")))
    return dc.specific_candidates(more)


@query("verified_candidates", "SELECT doc_id, code, path_key FROM candidates c WHERE code IN ('3A001', '5A992', '4A003') AND doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM signals) AND doc_id IN (SELECT doc_id FROM evidence WHERE polarity = 'present')")
def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify(views.briefs(spark, sf_dir))
    rows = c.candidates.select("doc_id", "code", "path_key", F.concat("code", F.lit(" para")).alias("paragraph"), (F.col("doc_id") % 5 != 0).alias("has_criteria"))
    regulations = spark.sql("SELECT * FROM (VALUES ('3A001', 'current', 'v1', true), ('5A002', 'current', '', true), ('5A991', 'needs_verification', 'v1', true), ('5A992', 'current', 'v1', true), ('4A003', 'current', 'v2', true)) AS v(code, verification_status, version, dated)")
    return rw.verified_candidates(rows, regulations, c.signals.select("doc_id"), c.evidence.where("polarity = 'present'").select("doc_id"))


_PRIOR = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '3A001' WHEN 1 THEN '9E999' ELSE '5A992' END AS code FROM {b}"


@query("candidate_transitions", f"""SELECT doc_id, code, 'deterministic_candidate_rules' AS from_stage, status AS to_status, reasons FROM ({{gate}}) UNION ALL
    SELECT doc_id, code, 'backend_local_rules', 'withdrawn', 'not_reproposed_by_canonical_path_rules' FROM ({_PRIOR.format(b='briefs')}) p WHERE NOT EXISTS (SELECT 1 FROM ({{gate}}) g WHERE g.doc_id = p.doc_id AND g.code = p.code)""".replace("{gate}", GATE))  # fmt: skip
def candidate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    c, forms = classify(docs), dc.product_form(docs)
    paths = dc.canonical_paths(c.evidence, forms)
    gated = dc.gate_candidates(c.candidates, paths, dc.assess_requirements(paths, forms, c.evidence), spark.sql(_REGULATIONS))
    return joined(dc.candidate_transitions(gated, spark.sql(_PRIOR, b=docs)), "reasons")


_CASES = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ai_accelerator' WHEN 1 THEN 'fpga_or_pld' ELSE '' END AS expected, CASE doc_id % 3 WHEN 0 THEN 'wireless_or_rf_device' ELSE '' END AS forbidden, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'ai_accelerator' END AS primary_, doc_id % 17 = 0 AS injection FROM {b}"


@query("evaluate_corpus", f"""SELECT doc_id, p AS profiles_ok, f AS primary_ok, i AS injection_ok, p AND f AND i AS ok FROM (SELECT doc_id, (expected = '' OR list_contains(d, expected)) AND NOT (forbidden <> '' AND list_contains(d, forbidden)) AS p, primary_ IS NULL OR primary_ = first_ AS f,
    NOT injection OR (doc_id IN (SELECT doc_id FROM briefs WHERE {" OR ".join(f"regexp_matches(lower(text), {text(p)})" for p in ev.wording.INSTRUCTIONS)}) AND doc_id NOT IN (SELECT doc_id FROM candidates)) AS i
    FROM ({_CASES.format(b='briefs')}) JOIN (SELECT doc_id, list(profile) AS d, max(profile) FILTER (rank = 1) AS first_ FROM ranked GROUP BY doc_id) USING (doc_id))""")  # fmt: skip
def evaluate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1]


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = views.briefs(spark, sf_dir)
    c = classify(docs)
    cases = spark.sql(_CASES, b=docs).select("doc_id", *[F.filter(F.array(k), lambda x: x != "").alias(k) for k in ("expected", "forbidden")], F.col("primary_").alias("primary"), "injection")
    return cases, evl.evaluate_corpus(cases, c.ranked, ev.untrusted(docs), c.candidates), c.candidates


_METRICS = """SELECT primary_ AS label, count(*) AS cases, count(*) FILTER (expected <> '' OR forbidden <> '') AS profile_assertions, count(*) FILTER ((expected <> '' OR forbidden <> '') AND profiles_ok) AS profile_correct, count(primary_) AS primary_assertions, count(primary_) FILTER (primary_ok) AS primary_correct,
  count(*) FILTER (injection AND injection_ok) AS injection_correct, count(*) FILTER (NOT ok) AS failing, coalesce(round(sum(bare) / sum(made), 4), 0) AS unsupported_rate FROM ({cases}) c JOIN ({verdicts}) v ON v.doc_id = c.doc_id LEFT JOIN (SELECT doc_id, count(*) AS made, count(*) FILTER (ordinal % 3 = 0) AS bare FROM candidates GROUP BY doc_id) n ON n.doc_id = c.doc_id GROUP BY primary_"""


@query("corpus_metrics", _METRICS.format(cases=_CASES.format(b="briefs"), verdicts=ORACLES["evaluate_corpus"]))
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, verdicts, candidates = _evaluated(spark, sf_dir)
    return evl.corpus_metrics(cases.withColumn("label", F.col("primary")), verdicts, candidates.select("doc_id", (F.col("ordinal") % 3 != 0).alias("supported")), "label")


_SIGNED = "SELECT doc_id, max(profile) FILTER (rank = 1) AS profile FROM ranked GROUP BY doc_id"


_PATHS_OF = "SELECT doc_id, string_agg(DISTINCT path_key, '|' ORDER BY path_key) AS opened FROM paths WHERE {0} GROUP BY doc_id"
_LESS = "NOT (doc_id % 7 = 0 AND path_key = 'general_electronics_fallback')"


@query("compare_signatures", f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.profile = b.profile AND coalesce(a.codes, '') = coalesce(b.codes, '') AND coalesce(a.opened, '') = coalesce(b.opened, '') AS same FROM
    (SELECT * FROM ({_SIGNED}) LEFT JOIN (SELECT doc_id, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM candidates GROUP BY doc_id) USING (doc_id) LEFT JOIN ({_PATHS_OF.format('true')}) USING (doc_id)) a FULL JOIN
    (SELECT * FROM ({_SIGNED}) LEFT JOIN (SELECT doc_id, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM candidates WHERE doc_id % 4 <> 0 GROUP BY doc_id) USING (doc_id) LEFT JOIN ({_PATHS_OF.format(_LESS)}) USING (doc_id) WHERE doc_id % 9 <> 0) b ON a.doc_id = b.doc_id""")  # fmt: skip
def compare_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.briefs(spark, sf_dir)
    c = classify(docs)
    first = c.ranked.where("rank = 1").select("doc_id", "profile")

    def signed(candidates: DataFrame, paths: DataFrame) -> DataFrame:
        codes = candidates.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
        opened = paths.groupBy("doc_id").agg(F.collect_list("path_key").alias("paths"))
        none = F.array().cast("array<string>")
        return first.join(large(codes), "doc_id", "left").join(large(opened), "doc_id", "left").select("doc_id", "profile", F.coalesce("paths", none).alias("paths"), F.coalesce("codes", none).alias("codes"))

    return evl.compare_signatures(signed(c.candidates, c.paths), signed(c.candidates.where("doc_id % 4 <> 0"), c.paths.where(_LESS)).where("doc_id % 9 <> 0"))

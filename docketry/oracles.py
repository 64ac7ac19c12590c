"""DuckDB SQL for the registered queries, written apart from the Spark code: rules are inlined as VALUES."""

from __future__ import annotations

import re

from docketry import views
from docketry.rules import profiles as pr
from docketry.rules import wording as wd
from docketry.rules.signals import SIGNALS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(text(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


def either(patterns: tuple[str, ...]) -> str:
    return text("|".join(f"(?:{p})" for p in patterns))


def holds(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(t)})" for t in terms) + ")"


SQUASH = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
SCOPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(quote), {text(p)}) THEN {text(s)}" for s, p in wd.SCOPES) + " END"
POLARITY = f"CASE WHEN regexp_matches(lower(quote), {either(wd.UNKNOWN)}) THEN 'unknown' WHEN regexp_matches(lower(quote), {either(wd.NEGATION)}) THEN 'absent' WHEN regexp_matches(lower(quote), {either(wd.CONDITIONAL)}) THEN 'ambiguous' ELSE 'present' END"
LINE = (
    f"CASE WHEN {holds('q', wd.HISTORICAL_MARKS)} THEN 'historical_context' WHEN {holds('q', wd.QUESTION_MARKS)} THEN 'question' WHEN {holds('q', wd.MISSING_MARKS)} THEN 'missing_evidence' "
    f"WHEN regexp_matches(q, {text(wd.NEGATED_CRYPTO)}) THEN 'negated' WHEN {holds('q', wd.CONDITIONAL_MARKS)} THEN 'conditional' ELSE 'affirmed' END"
)

#: name -> SQL; each may use those before it.
STEPS: dict[str, str] = {
    "briefs": views.BRIEFS,
    "pieces": "SELECT doc_id, unnest(range(len(p))) AS ordinal, unnest(p) AS piece FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n\\r]+[.!?]*|[.!?\\n\\r]+') AS p FROM briefs)",
    "segs": f"""SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(stop - length(piece) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", {SQUASH.format('piece')} AS quote
        FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS stop FROM pieces) WHERE regexp_matches({SQUASH.format('piece')}, '[^.!?\\n\\r]')""",
    "terms": f"SELECT * FROM {values([(k, i, t) for k, _, _, ts in SIGNALS for i, t in enumerate(ts)])} AS v(signal, pos, term)",
    "weights": f"SELECT * FROM {values([(k, w) for k, _, w, _ in SIGNALS])} AS v(signal, weight)",
    "serves": f"SELECT * FROM {values([(k, p) for k, ps, _, _ in SIGNALS for p in ps])} AS v(signal, profile)",
    "hits": """SELECT doc_id, signal, list(term ORDER BY pos) AS terms, quote, start, "end" FROM segs JOIN terms
        ON contains(lower(quote), term) AND regexp_matches(' ' || lower(quote) || ' ', '[^a-z0-9]' || regexp_escape(term) || '[^a-z0-9]') GROUP BY doc_id, signal, quote, start, "end" """,
    "marked": f"SELECT *, {POLARITY} AS polarity, {SCOPE} AS scope, 'ev_' || substr(sha256(signal || chr(31) || quote || chr(31) || start), 1, 20) AS evidence_id FROM hits",
    "evidence": "SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY doc_id, signal, lower(quote), polarity, scope ORDER BY start) = 1",
    "tiers": """SELECT *, CASE WHEN scope = 'current_configuration' THEN 1 WHEN scope IS NULL THEN 2 ELSE 3 END AS tier FROM evidence""",
    "considered": "SELECT * FROM tiers QUALIFY tier = least(min(tier) OVER (PARTITION BY doc_id, signal), 3)",
    "effective": """SELECT doc_id, signal, CASE WHEN bool_or(polarity = 'present') AND bool_or(polarity = 'absent') THEN 'ambiguous' WHEN bool_or(polarity = 'absent') THEN 'absent'
        WHEN bool_or(polarity = 'present') THEN 'present' WHEN bool_or(polarity = 'ambiguous') THEN 'ambiguous' ELSE 'unknown' END AS effective FROM considered GROUP BY doc_id, signal""",
    "pairs": """SELECT doc_id, signal, a.evidence_id AS evidence_a, b.evidence_id AS evidence_b, coalesce(a.scope <> b.scope, false) AS apart
        FROM evidence a JOIN evidence b USING (doc_id, signal) WHERE a.polarity = 'present' AND b.polarity = 'absent'""",
    "contradictions": """SELECT doc_id, signal, evidence_a, evidence_b, CASE WHEN apart THEN 'configuration_conflict' ELSE 'explicit_positive_vs_negative' END AS kind,
        CASE WHEN apart THEN 'major' ELSE 'blocking' END AS severity, CASE WHEN apart THEN 'resolved_by_scope' ELSE 'unresolved' END AS resolution FROM pairs""",
    "positives": "SELECT e.* FROM evidence e JOIN effective f USING (doc_id, signal) WHERE e.polarity = 'present' AND f.effective = 'present'",
    "signals": """SELECT doc_id, signal, CAST(any_value(weight) + least(2, len(list_distinct(flatten(list(terms)))) - 1 ) AS INTEGER) AS contribution, list_sort(list_distinct(flatten(list(terms)))) AS terms,
        list(quote ORDER BY start)[1:4] AS quotes, list(evidence_id ORDER BY start)[1:8] AS evidence_ids FROM positives JOIN weights USING (signal) GROUP BY doc_id, signal""",
    "scores": "SELECT doc_id, profile, CAST(sum(contribution) AS INTEGER) AS score FROM signals JOIN serves USING (signal) GROUP BY doc_id, profile",
    "roles": f"SELECT * FROM {values([(p, s, 1) for p, r, _, _, _ in pr.CONTRACTS for s in r] + [(p, s, 0) for p, _, e, _, _ in pr.CONTRACTS for s in e])} AS v(profile, signal, required)",
    "limits": f"SELECT * FROM {values([(p, n, t, pr.PROFILES.index(p)) for p, _, _, n, t in pr.CONTRACTS])} AS v(profile, least, threshold, place)",
    "seen": """SELECT doc_id, profile, count(*) FILTER (required = 1 AND effective = 'present') AS positive, bool_or(required = 0 AND effective = 'absent') AS excluded,
        bool_or(required = 1 AND EXISTS (SELECT 1 FROM contradictions c WHERE c.doc_id = f.doc_id AND c.signal = f.signal AND severity = 'blocking')) AS blocked
        FROM effective f JOIN roles USING (signal) GROUP BY doc_id, profile""",
    "eligibility": """SELECT doc_id, profile, coalesce(score, 0) AS score, CAST(coalesce(positive, 0) AS INTEGER) AS positive,
        CASE WHEN coalesce(excluded, false) OR coalesce(blocked, false) OR coalesce(positive, 0) < least THEN 'ineligible' WHEN coalesce(score, 0) < threshold THEN 'insufficient_score' ELSE 'eligible' END AS state
        FROM scores FULL JOIN seen USING (doc_id, profile) JOIN limits USING (profile)""",
    "detected": """SELECT * FROM (SELECT doc_id, profile, score, place, bool_or(profile = 'fpga_programmable_logic_soc') OVER (PARTITION BY doc_id) AS soc, max(score) OVER (PARTITION BY doc_id) AS whole
        FROM eligibility JOIN limits USING (profile) WHERE state = 'eligible') WHERE NOT (soc AND profile IN ('fpga_or_pld', 'adc_dac_converter', 'networking_hardware'))""",
    "close": """SELECT *, CASE WHEN max(score) OVER (PARTITION BY doc_id) - score <= 5 THEN CASE profile WHEN 'ai_accelerator' THEN 1 WHEN 'gpu_accelerator' THEN 2 WHEN 'secure_networking_hardware' THEN 3 END END AS near FROM detected""",
    "ranked": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(near = lead_, false) DESC, score DESC, place) AS INTEGER) AS rank, profile, score
        FROM (SELECT *, min(near) OVER (PARTITION BY doc_id) AS lead_ FROM close)
        UNION ALL SELECT doc_id, 1, 'unknown', 0 FROM briefs WHERE doc_id NOT IN (SELECT doc_id FROM detected)""",
    "leads": f"SELECT * FROM {values([(p, i, k) for p, ks in pr.PATHS for i, k in enumerate(ks)])} AS v(profile, pos, path_key)",
    "titles": f"SELECT * FROM {values(list(pr.PATH_TITLES))} AS v(path_key, title)",
    "opened": """SELECT doc_id, path_key, min(place) AS place FROM (
        SELECT doc_id, path_key, rank * 10 + pos AS place FROM ranked JOIN leads USING (profile)
        UNION ALL SELECT doc_id, 'category_5_part_2_security', 1000 FROM effective WHERE signal IN ('platform_security', 'transport_security') AND effective IN ('present', 'ambiguous')
        UNION ALL SELECT doc_id, 'radio_wireless', 1001 FROM effective WHERE signal = 'radio' AND effective = 'ambiguous'
        UNION ALL SELECT doc_id, 'general_electronics_fallback', 1002 FROM ranked WHERE rank = 1 AND profile NOT IN ('general_electronics', 'unknown')) GROUP BY doc_id, path_key""",
    "paths": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INTEGER) AS ordinal, path_key, title FROM opened JOIN titles USING (path_key)",
    "items": f"SELECT * FROM {values([(p, i, x) for p, xs in pr.MISSING for i, x in enumerate(xs)])} AS v(profile, pos, item)",
    "missing": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS INTEGER) AS ordinal, item
        FROM (SELECT doc_id, item, min(rank * 10 + pos) AS place FROM ranked JOIN items USING (profile) GROUP BY doc_id, item)""",
    "crypto_lines": f"SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, lower(line) AS q FROM briefs) WHERE {LINE} = 'affirmed'",
    "crypto_terms": f"SELECT * FROM {values([(t, int(len(t) <= 4)) for t in wd.CRYPTO_TERMS])} AS v(term, short)",
    "crypto": """SELECT b.doc_id, count(term) > 0 AS supported, coalesce(string_agg(DISTINCT term, '|' ORDER BY term), '') AS terms FROM briefs b
        LEFT JOIN (SELECT doc_id, term FROM crypto_lines JOIN crypto_terms ON contains(q, term) AND (short = 0 OR regexp_matches(q, '\\b' || term || '\\b'))) x ON b.doc_id = x.doc_id GROUP BY b.doc_id""",
    "codes": f"SELECT * FROM {values(list(pr.CANDIDATES))} AS v(path_key, pos, code)",
    "candidates": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, pos) AS INTEGER) AS ordinal, code,
        CASE WHEN code = '5A002' AND NOT supported THEN 'blocked_candidate' ELSE 'review_candidate' END AS candidate_type, path_key FROM paths JOIN codes USING (path_key) JOIN crypto USING (doc_id)""",
    "history": views.HISTORY_DOCS,
    "runs": views.RUNS,
}


def sql(final: str) -> str:
    """The statement with the steps that it needs, found by their names."""
    need: list[str] = []

    def add(body: str) -> None:
        for name in STEPS:
            if name not in need and re.search(rf"\b{name}\b", body):
                need.append(name)
                add(STEPS[name])

    add(final)
    order = [n for n in STEPS if n in need]
    return "WITH " + ", ".join(f"{n} AS ({STEPS[n]})" for n in order) + " " + final if order else final

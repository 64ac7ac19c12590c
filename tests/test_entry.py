"""The entry point: it imports without the text operators, and oracles name what queries return."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from docketry.registry import ORACLES, QUERIES

from .conftest import ROOT, SMALL


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert {"doc_id", "profile", "score"} == set(rows[0].asDict()) and len({r.profile for r in rows}) > 5


@pytest.mark.parametrize("name", [
    "primary_profile", "open_paths", "mark_duplicates", "check_transitions", "audit_log", "drop_generic_facts", "capability_signals", "extract_markers", "text_previews",
    "score_matches", "role_pools", "check_projection", "history_detail", "check_uploads", "content_key", "completion_status", "memo_versions", "mentions", "document_role", "memo_sections", "chunk_text", "chunk_documents", "ingest_history", "ingested_chunks", "logical_lines", "resolve_entities", "owned_evidence", "qualify", "intake_reports", "rank_manufacturer", "rank_interface_revision", "profile_facts", "fact_links", "comparison_section", "integrity_backfill", "demoted_candidates", "output_checks", "decision_records", "semantic_checks", "run_verdicts", "review_report", "extract_identity", "context_filtered_facts", "context_snippets", "budget_text", "prior_stage_candidates", "history_questions", "stored_runs", "corpus_metrics", "compare_signatures",
])
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    for table in ("part", "documents", "orders", "lineitem", "events", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    ours = QUERIES[name](spark, SMALL)
    columns = sorted(ours.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=key) == sorted(theirs, key=key)


def test_entry_works_without_the_text_operators(tmp_path):
    for path in ("__spark_entry__.py", "docketry"):
        subprocess.run(["cp", "-r", str(ROOT / path), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "docketry" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'primary_profile' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})

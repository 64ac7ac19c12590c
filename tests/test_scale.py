"""What holds at every size: no table of the input is broadcast, short rows are dealt to many tasks, facts are derived once."""

from __future__ import annotations

import pytest

from docketry import views
from docketry.operators import history as hs
from docketry.operators import retrieval as rt
from docketry.registry import QUERIES

from .conftest import SMALL


def broadcasts(plan: str) -> list[str]:
    """What stands below each broadcast of a plan."""
    lines, found = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = len(line) - len(line.lstrip(" :+-*"))
            below = next((j for j, x in enumerate(lines[i + 1 :], i + 1) if len(x) - len(x.lstrip(" :+-*")) <= deep), len(lines))
            found.append("\n".join(lines[i:below]))
    return found


@pytest.mark.parametrize("name", ["demoted_candidates", "fact_links", "run_verdicts", "decision_records", "decision_rollup", "review_report", "score_signals", "semantic_checks"])
def test_only_rule_tables_are_broadcast(spark, name):
    out = QUERIES[name](spark, SMALL)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in broadcasts(plan) if "FileScan" in x or "InMemoryTableScan" in x]
    spark.catalog.clearCache()


def test_short_rows_are_dealt_to_many_tasks(spark):
    rows = spark.range(100_000).selectExpr("id AS p_partkey")
    assert views.dealt(rows.coalesce(1), "p_partkey").rdd.getNumPartitions() >= 100_000 // views.ROWS_A_TASK


def test_alike_chunks_and_queries_are_searched_as_classes(spark):
    """The rows of search_lexical, with ties, repeated words, tenants and chunks of no asked word."""
    chunks = spark.range(3_000).selectExpr(
        "'org' || id % 2 AS org_id", "id AS chunk_id", "id % 40 AS created_at", "concat_ws(' ', 'id' || id, repeat('memo ', int(id % 3)), CASE id % 7 WHEN 0 THEN 'switch' WHEN 1 THEN 'radio switch' ELSE 'other' END, 'SX' || id % 90) AS text"
    )
    asked = spark.range(200).selectExpr("'org' || id % 2 AS org_id", "id AS query_id", "array('zz' || id, 'memo', IF(id % 3 = 0, 'radio', 'switch'), 'sx' || id) AS terms")
    sort = lambda df: sorted(tuple(r) for r in df.select("org_id", "query_id", "chunk_id", "matches", "score", "rank").collect())
    ours = sort(hs.search_alike(asked, chunks))
    assert len(ours) == 10_000 and ours == sort(hs.search_lexical(asked, chunks))
    assert len(sort(hs.search_alike(asked, chunks, 2_000))) == len(sort(hs.search_lexical(asked, chunks, 2_000)))
    spark.catalog.clearCache()


def test_each_term_is_looked_for_once(spark):
    """The newest chunks of any term, equal to a look at every pair; no pair of a query and a chunk is compared in the plan."""
    chunks = spark.range(2_000).selectExpr("'org' || id % 2 AS org_id", "id AS chunk_id", "id % 30 AS created_at", "'T' AS title", "'f.txt' AS file_name", "concat_ws(' ', 'Memo', id % 50, IF(id % 9 = 0, 'ab', 'switchboard')) AS content")
    asked = spark.range(60).selectExpr("'org' || id % 2 AS org_id", "id AS query_id", "array('memo ' || id, IF(id % 3 = 0, 'ab', 'board'), 'zz' || id) AS terms")
    out = rt.search_keyword(asked, chunks)
    hay = [(r.org_id, r.chunk_id, r.created_at, f"{r.title}\n{r.file_name}\n{r.content}".lower()) for r in chunks.collect()]
    for q in asked.collect():
        newest = sorted((-t, c) for o, c, t, h in hay if o == q.org_id and any(x in h for x in q.terms))[:50]
        assert [r.chunk_id for r in out.where(f"query_id = {q.query_id}").orderBy("rank").collect()] == [c for _, c in newest]
        if q.query_id == 5:
            break
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner, " in x]
    assert joins and all(x.count(" = ") > 1 for x in joins if "org_id" in x)

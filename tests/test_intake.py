"""Structured chunks, ingestion and entities on hand-made cases."""

from __future__ import annotations

import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.operators import chunking as ch
from docketry.operators import entities as en
from docketry.streaming import jobs

TEXTS = "history_doc_id long, text string"


def contents(spark, texts, chunks=ch.chunk_documents):
    rows = chunks(spark.createDataFrame(list(enumerate(texts)), TEXTS)).orderBy("history_doc_id", "ordinal").collect()
    return [[r.content for r in rows if r.history_doc_id == i] for i in range(len(texts))], rows


def test_router_tells_json_from_csv_from_prose(spark):
    texts = ['[{"b": 1, "a": [1, 2.0]}, "x\\"y", 5, null, "7"]', '{"n": 1, "rows": [{"z": 1}, {"y": "[q]"}], "more": [1]}', '{"n": "[1]"}', '{"a": 1} tail', '{"a":1}],[{"b":1}', "[]", "5", 'a,,c\n1,"x, ""y"" z"\n"two\nlines",2\n,', "a,b", None, "", "  [1]  ", '"p","q"\r\nv']
    found, rows = contents(spark, texts)
    assert found == [['{"b":1,"a":[1,2.0]}', '"x\\"y"', "5", "null", '"7"'], ['{"z":1}', '{"y":"[q]"}'], ['{"n":"[1]"}'], ['{"a": 1} tail'], ['{"a":1}],[{"b":1}'], ["[]"], ["5"], ['a: 1\ncolumn_2: x, "y" z\nc: ', "a: two\nlines\ncolumn_2: 2\nc: "], ["a,b"], [], [], ["1"], ["p: v\nq: "]]
    assert all(r.char_end - r.char_start == len(r.content) for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.lists(st.text("ab \",\nx'", max_size=6), min_size=2, max_size=4), min_size=1, max_size=5), min_size=1, max_size=12))
def test_quoted_csv_reads_as_written(spark, tables):
    texts = []
    for rows in tables:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows([["head", "other"], *rows])
        texts.append(out.getvalue().rstrip("\n"))
    found, _ = contents(spark, texts, ch.explode_csv)
    for rows, told in zip(tables, found):
        kept = [[c.strip() for c in row] for row in rows if any(c.strip() for c in row)]
        assert told == [f"head: {row[0]}\nother: {row[1]}" for row in kept]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.recursive(st.none() | st.booleans() | st.integers(-9, 9**9) | st.text("a[]{}\",\\ é", max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abk", max_size=3), x, max_size=3), max_leaves=6), min_size=1, max_size=4), min_size=1, max_size=10))
def test_json_records_keep_their_order(spark, arrays):
    found, _ = contents(spark, [json.dumps(a, ensure_ascii=False) for a in arrays], ch.explode_json)
    assert found == [[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in a] for a in arrays]


def test_ingestion_outcomes(spark):
    rows = [("o", 1, "some words", 1, "queued", 0), ("o", 2, "some words", 2, "queued", 0), ("o", 3, "  ", 3, "queued", 1), ("o", 4, None, 4, "queued", 0), ("o", 5, "kept", 5, "indexed", 2), ("o", 6, "x" * 1_000_001, 6, "queued", 0)]
    done, chunks, markers = ch.ingest_history(spark.createDataFrame(rows, "org_id string, history_doc_id long, text string, created_at long, ingestion_status string, attempt_count int"))
    got = {r.history_doc_id: (r.ingestion_status, r.error_code, r.attempt_count) for r in done.collect()}
    assert got == {1: ("indexed", None, 1), 2: ("duplicate", None, 0), 3: ("failed", "INGESTION_FAILED", 2), 4: ("failed", "TEXT_EXTRACTION_FAILED", 1), 5: ("indexed", None, 2), 6: ("failed", "INGESTION_FAILED", 1)}
    assert [(r.history_doc_id, r.content) for r in chunks.collect()] == [(1, "some words")] and markers.columns == ["doc_id", "kind", "place", "value"]


def test_tables_give_their_subject_first(spark):
    assert en.table_heads(["Product | Memory", "--- | ---", "A | 1", "B | 2 | 3", "Model, x", "no row", "Device, y", "1, 2"]) == [-2, -2, 0, -1, -1, -1, -2, 6]
    docs = spark.createDataFrame([(1, "Memory | Product\n---|---\n8 GB | AX1\n9 GB | BX2\n | CX3"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.line for r in en.logical_lines(docs).where("doc_id = 1").orderBy("line_no", "place").collect()] == ["Product: AX1 [row:3]", "Memory: 8 GB [row:3]", "Product: BX2 [row:4]", "Memory: 9 GB [row:4]", " | CX3"]


def test_relations_depend_on_the_subjects_before(spark):
    texts = ["Includes AB12 card\nIncludes CD34 module\nMemory: 8 GB", "Product: NX120 SmartNIC\nProcessor: ARM Cortex-A53\nPrior record: CASE-5678\nReplaces NX110", "Product | Memory\nAX1 card | 4 GB\nBX2 card | 8 GB", None, "", "Installation readme only"]
    docs = spark.createDataFrame([(i, t, "f.txt") for i, t in enumerate(texts)], "doc_id long, text string, file_name string")
    found = en.resolve_entities(docs)
    ties = {(r.doc_id, r.entity): (r.relation, r.parent) for r in found.collect()}
    assert ties[0, "ab12"] == ("primary_subject", None) and ties[0, "cd34"][0] == "included_component" and ties[0, "8 GB"][1] == "ab12"
    assert ties[1, "nx110"] == ("predecessor_reference", "nx120") and ties[1, "CASE-5678"] == ("history_reference", "nx120") and ties[2, "bx2"] == ("secondary_subject", None)
    state = {r.doc_id: r.state for r in en.qualify(docs, en.owned_evidence(found, docs)).collect()}
    assert state == {0: "single_product_insufficient_evidence", 1: "single_product_classifiable", 2: "multi_entity_requires_segmentation", 3: "insufficient_product_evidence", 4: "insufficient_product_evidence", 5: "non_product_context"}


def test_stream_ingests_queued_documents_once(spark, tmp_path):
    schema = "org_id string, history_doc_id long, text string, created_at long, ingestion_status string, attempt_count int, ingestion_version int"
    for n, rows in enumerate([[("o", 1, '[{"a": 1}, {"a": 2}]', 1, "queued", 0, 1), ("o", 2, " ", 2, "queued", 0, 1)], [("o", 3, "prose", 3, "queued", 1, 2), ("o", 4, "waits", 4, "held", 0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        queue = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(queue, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    done = {r.history_doc_id: (r.ingestion_status, r.attempt_count) for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect()}
    assert done == {1: ("indexed", 1), 2: ("failed", 1), 3: ("indexed", 2)}
    chunks = spark.read.parquet(str(tmp_path / "out" / "chunks")).collect()
    assert sorted((r.history_doc_id, r.ordinal, r.content, r.ingestion_version) for r in chunks) == [(1, 0, '{"a":1}', 1), (1, 1, '{"a":2}', 1), (3, 0, "prose", 2)]

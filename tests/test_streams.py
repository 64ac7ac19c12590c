"""State that expires, events without a place, and ingestion that knows what earlier batches wrote."""

from __future__ import annotations

import datetime

from docketry.streaming import jobs

QUEUE = "org_id string, history_doc_id long, text string, created_at long, ingestion_status string, attempt_count int, ingestion_version int"


def streamed(spark, tmp_path, schema, frames, make):
    """The rows that come out, and how many keys have state after each frame."""
    out, kept, source = [], [], tmp_path / "source"
    source.mkdir(parents=True)
    query = make(spark.readStream.schema(schema).parquet(str(source))).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state"))
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        done = query.trigger(availableNow=True).start()
        done.awaitTermination()
        kept.append(done.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, kept


def test_a_window_is_dropped_after_its_end(spark, tmp_path):
    frames = [[("k", 0.0), ("n", None)], [("k", 5.0), (None, 6.0)], [("j", 9_000.0)], [("k", 9_001.0), ("j", 9_002.0)]]
    rows, kept = streamed(spark, tmp_path, "key string, ts double", frames, lambda s: jobs.stream_rate_limit(s, 1, 60.0))
    assert {(r.key, r.ts): r.allowed for r in rows} == {("k", 0.0): True, ("k", 5.0): False, ("", 6.0): True, ("j", 9_000.0): True, ("k", 9_001.0): True, ("j", 9_002.0): False}
    assert kept[1] == 2 and kept[2] == 1


def test_a_status_without_a_seq_changes_nothing(spark, tmp_path):
    frames = [[(1, 1, "pending"), (1, None, "failed"), (2, None, "queued")], [(1, 2, "queued"), (2, 5, "running")]]
    rows, _ = streamed(spark, tmp_path, "run_id long, seq long, status string", frames, jobs.stream_transitions)
    assert {(r.run_id, r.seq, r.from_status, r.to_status): (r.allowed, r.late) for r in rows} == {(1, None, "pending", "failed"): (False, True), (1, 2, "pending", "queued"): (True, False)}


def test_a_run_is_forgotten_after_its_time(spark, tmp_path):
    at = lambda s: datetime.datetime.fromtimestamp(1_000_000 + s)
    frames = [[(1, 1, "pending", at(0))], [(1, 2, "queued", at(50))], [(2, 1, "pending", at(20_000))], [(1, 3, "running", at(20_001)), (2, 2, "queued", at(20_002))]]
    rows, kept = streamed(spark, tmp_path, "run_id long, seq long, status string, created_at timestamp", frames, lambda s: jobs.stream_transitions(s, keep=100.0))
    assert {(r.run_id, r.to_status): r.allowed for r in rows} == {(1, "queued"): True, (2, "queued"): True} and kept[2] == 1


def test_ingestion_knows_earlier_batches(spark, tmp_path):
    batches = [
        [("o", 1, "some prose", 1, "queued", 0, 1), ("o", 1, "some prose", 1, "queued", 0, 1), ("o", 2, "some prose", 2, "queued", 0, 1)],
        [("o", 1, "some prose", 1, "queued", 1, 1), ("o", 3, "some prose", 3, "queued", 0, 1), ("p", 4, "some prose", 4, "queued", 0, 1)],
        [("o", 1, "new prose", 1, "queued", 1, 2), ("o", 3, "some prose", 3, "queued", 0, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, QUEUE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_ingest(spark.readStream.schema(QUEUE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    done = sorted((r.batch, r.history_doc_id, r.ingestion_version, r.ingestion_status, r.duplicate_of) for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect())
    assert done == [(0, 1, 1, "indexed", None), (0, 2, 1, "duplicate", 1), (1, 3, 1, "duplicate", 1), (1, 4, 1, "indexed", None), (2, 1, 2, "indexed", None)]
    chunks = sorted((r.history_doc_id, r.ingestion_version, r.ordinal, r.content) for r in spark.read.parquet(str(tmp_path / "out" / "chunks")).collect())
    assert chunks == [(1, 1, 0, "some prose"), (1, 2, 0, "new prose"), (4, 1, 0, "some prose")]

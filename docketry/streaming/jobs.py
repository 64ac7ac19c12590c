"""The same operators on streams: deduplication, anchored rate windows and status changes."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry.operators import chunking as ch
from docketry.rules import review as rules


def stream_dedupe(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first upload of each tenant's content; state older than the watermark is dropped.  uploads(org_id, sha256, created_at)."""
    return uploads.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["org_id", "sha256"])


def limited(seconds: list[float], limit: int, window: float, start: float | None = None, count: int = 0) -> tuple[list[tuple[bool, int, bool]], float | None, int]:
    """(allowed, retry seconds, late) of each event time in order, and the window's start and count after them.

    A window opens at the first event after the one before has run out.
    """
    out = []
    for t in seconds:
        if start is not None and t < start:
            out.append((True, 0, True))  # older than the open window: reported late, no change of state
        elif start is None or t >= start + window:
            start, count = t, 1
            out.append((True, 0, False))
        elif count >= limit:
            out.append((False, max(1, ceil(start + window - t)), False))
        else:
            count += 1
            out.append((True, 0, False))
    return out, start, count


RATE_SCHEMA = "key string, ts double, allowed boolean, retry_seconds int, late boolean"


def rate_limit(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Batch form over events(key, ts): one row an event.

    Events are dealt by key and walked in order of time; only the open window's
    start and count of one key are carried from batch to batch, so a key of any
    size is never gathered.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for part in parts:
            made = []
            for key, some in part.groupby("key", sort=False, dropna=False):
                if key != last:
                    last, start, count = key, None, 0
                out, start, count = limited(some["ts"].tolist(), limit, window, start, count)
                made += out
            yield part.assign(allowed=[m[0] for m in made], retry_seconds=[m[1] for m in made], late=[m[2] for m in made])

    rows = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("ts").cast("double").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, RATE_SCHEMA)


#: Seconds added to times that may count from any origin: the watermark begins at the epoch and lets nothing before it through.
SHIFT = 1_000_000_000


def stream_rate_limit(events: DataFrame, limit: int, window: float, delay: str = "1 hour") -> DataFrame:
    """rate_limit() on a stream: the window's start and count are the state of a key, dropped once the watermark is past the window's end.

    A later event opens a window anyway, so nothing changes by the drop; events older than ``delay`` behind the latest
    are left out by the watermark.  A key's events of one micro-batch are sorted in memory; what a batch may hold is
    bounded at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        group = pd.concat(list(parts)).sort_values("ts", kind="stable")
        made, start, count = limited(group["ts"].tolist(), limit, window, start, count)
        state.update((start, count))
        state.setTimeoutTimestamp(max(ceil((start + window + SHIFT) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": group["key"].to_numpy(), "ts": group["ts"].to_numpy(), "allowed": [m[0] for m in made], "retry_seconds": [m[1] for m in made], "late": [m[2] for m in made]})

    rows = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("ts").cast("double").alias("ts")).where("ts IS NOT NULL").withColumn("at", F.timestamp_seconds(F.col("ts") + SHIFT))
    return rows.withWatermark("at", delay).groupBy("key").applyInPandasWithState(run, RATE_SCHEMA, "start double, count int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_transitions(events: DataFrame, keep: float = 7 * 86_400, delay: str = "1 hour") -> DataFrame:
    """Each status change of events(run_id, seq, status[, created_at]) against the allowed pairs; the last status of a run is its state.

    With created_at, the state of a run is dropped once the watermark is ``keep`` seconds past its last event; without
    it, it is kept for ever.  An event without a seq has no place in the order: it is reported late and changes nothing.
    """
    allowed, timed = set(rules.TRANSITIONS), "created_at" in events.columns

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, None)
        group, out = pd.concat(list(parts)).sort_values("seq", na_position="last"), []
        for seq, status in group[["seq", "status"]].itertuples(index=False):
            seq = None if pd.isna(seq) else int(seq)
            late = seq is None or (seen is not None and seq <= seen)
            if last is not None:
                out.append((key[0], seq, last, status, not late and (last, status) in allowed, late))
            if not late:
                last, seen = status, seq
        if last is not None:
            state.update((last, seen))
            if timed:
                state.setTimeoutTimestamp(max(int((group["created_at"].max().timestamp() + keep) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "seq", "from_status", "to_status", "allowed", "late"]).astype({"seq": "Int64"})

    rows, timeout = (events.withWatermark("created_at", delay), GroupStateTimeout.EventTimeTimeout) if timed else (events, GroupStateTimeout.NoTimeout)
    return rows.groupBy("run_id").applyInPandasWithState(run, "run_id long, seq long, from_status string, to_status string, allowed boolean, late boolean", "last string, seen long", "append", timeout)


LEDGER = "org_id string, history_doc_id bigint, created_at bigint, ingestion_status string, sha256 string, ingestion_version int, batch int"


def _ledger(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The outcomes that other batches have written; none before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path).where(F.col("batch") != batch)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def stream_ingest(queue: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Ingests queued documents of a stream, a micro-batch at a time, with the batch functions; ends when the source is read up.

    queue has the columns that ingested() takes, and ingestion_version.  What was written is the ledger: a document
    and version that an earlier batch has an outcome for isn't ingested again, and a content that an earlier batch
    indexed for the tenant is a duplicate of that document.  Outcomes and chunks are written as one folder a batch, so
    a batch that is run again replaces its own rows; (document, version, ordinal) is there once.
    """

    def write(batch: DataFrame, n: int) -> None:
        before = _ledger(batch.sparkSession, f"{path}/documents", n)
        docs = batch.where("ingestion_status = 'queued'").dropDuplicates(["history_doc_id", "ingestion_version"])
        docs = docs.join(before.select("history_doc_id", "ingestion_version"), ["history_doc_id", "ingestion_version"], "left_anti").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).persist()
        try:
            known = before.where("ingestion_status = 'indexed'").groupBy("org_id", "sha256").agg(F.min(F.struct("created_at", "history_doc_id")).alias("first"))
            held = docs.alias("d").join(known.alias("k"), ["org_id", "sha256"]).where("k.first.history_doc_id <> d.history_doc_id")
            again = held.select("d.*", F.col("k.first.history_doc_id").alias("duplicate_of")).withColumns({"ingestion_status": F.lit("duplicate"), "error_code": F.lit(None).cast("string")})
            fresh = docs.join(again.select("history_doc_id", "ingestion_version"), ["history_doc_id", "ingestion_version"], "left_anti").drop("sha256")
            done, chunks, _ = ch.ingest_history(fresh)
            done.unionByName(again).drop("text").write.mode("overwrite").parquet(f"{path}/documents/batch={n}")
            versions = docs.select("history_doc_id", "ingestion_version")
            chunks.join(versions, "history_doc_id").write.mode("overwrite").parquet(f"{path}/chunks/batch={n}")
        finally:
            docs.unpersist()

    return queue.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

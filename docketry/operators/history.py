"""The history corpus: duplicates, batches, chunks, lexical matches and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docketry.functions.joins import large
from docketry.rules import review as rules

WHITE = " \t\n\x0b\f\r"


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """docs(org_id, history_doc_id, text, created_at) with sha256 and duplicate_of: the earliest document of the same tenant and content.

    The earliest is one aggregate by (tenant, hash) with a map-side step, so a
    content that is uploaded very often is no hot window.
    """
    hashed = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    first = hashed.groupBy("org_id", "sha256").agg(F.min(F.struct("created_at", "history_doc_id")).alias("first"))
    out = hashed.join(large(first), ["org_id", "sha256"])
    original = F.col("first.history_doc_id")
    return out.withColumn("duplicate_of", F.when(original != F.col("history_doc_id"), original)).drop("first")


def batch_status(docs: DataFrame) -> DataFrame:
    """(org_id, batch_id, counts by state, status) of each upload batch."""
    state = F.col("ingestion_status")
    counted = docs.groupBy("org_id", "batch_id").agg(
        F.count("*").alias("files"), *[F.count_if(state == s).alias(s) for s in ("queued", "processing", "indexed", "failed", "duplicate")]
    )
    completed = F.col("indexed") + F.col("duplicate")
    pending = F.col("files") - completed - F.col("failed")
    status = (
        F.when((pending > 0) & (F.col("processing") > 0), "processing").when(pending > 0, "queued")
        .when((F.col("failed") > 0) & (completed > 0), "completed_with_errors").when(F.col("failed") > 0, "failed").otherwise("completed")
    )
    return counted.withColumn("completed", completed).withColumn("status", status)


def chunk_text(docs: DataFrame, size: int = rules.CHUNK_SIZE, overlap: int = rules.CHUNK_OVERLAP, least: int = rules.CHUNK_LEAST) -> DataFrame:
    """docs(history_doc_id, text) to (history_doc_id, ordinal, char_start, char_end, content, content_hash).

    The bounds of a text are one fold: the next chunk opens ``overlap`` characters
    before the last bound; a bound moves back to the last line end of the chunk's
    rear part, if there is one.  Chunks without content keep their ordinal.
    """
    text = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(WHITE))
    rows = docs.select("history_doc_id", text.alias("body")).withColumn("n", F.length("body")).where("n > 0")

    def span(start: Column) -> Column:
        full = start + size
        # the rear part, read backwards: how far its last line end is from the bound
        back = F.instr(F.reverse(F.substring(F.col("body"), start + least + 2, F.lit(size - least))), "\n")
        return F.struct(start.alias("start"), F.when(full >= F.col("n"), F.col("n")).when(back > 0, full + 1 - back).otherwise(full).cast("int").alias("stop"))

    def longer(made: Column, _: Column) -> Column:
        stop = F.element_at(made, -1)["stop"]
        opened = F.greatest(stop - overlap, F.element_at(made, -1)["start"] + 1)
        return F.when(stop >= F.col("n"), made).otherwise(F.concat(made, F.array(span(opened))))

    turns = F.sequence(F.lit(1), F.ceil(F.col("n") / (least + 1 - overlap)).cast("int"))
    spans = F.aggregate(turns, F.array(span(F.lit(0))), longer)
    cut = rows.select("history_doc_id", "body", F.posexplode(spans).alias("ordinal", "span"))
    content = F.trim(F.substring(F.col("body"), F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")), F.lit(WHITE))
    cut = cut.select("history_doc_id", "ordinal", F.col("span.start").alias("char_start"), content.alias("content")).where("content <> ''")
    return cut.select("history_doc_id", "ordinal", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), "content", F.sha2("content", 256).alias("content_hash"))


def memo_sections(memos: DataFrame) -> DataFrame:
    """(run_id, ordinal, key, content) of memos(run_id, markdown), parted at headings of level two; what stands before them is the root."""
    parts = memos.select("run_id", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), r"\n##\s+")).alias("ordinal", "part"))
    root = F.col("ordinal") == 0
    return parts.select("run_id", "ordinal", F.when(root, "root").otherwise(F.trim(F.substring_index("part", "\n", 1))).alias("key"), F.when(root, F.col("part")).otherwise(F.concat(F.lit("## "), "part")).alias("content"))


def _tokens(column: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"({rules.TOKEN})"), F.lit(1)), lambda t: F.lower(t))


def query_terms(queries: DataFrame, most: int = rules.QUERY_TERMS) -> DataFrame:
    """(org_id, query_id, terms): the first distinct tokens that are no stop words."""
    words = F.array_distinct(F.filter(_tokens("text"), lambda t: ~t.isin(*rules.STOP_WORDS)))
    return queries.select("org_id", "query_id", F.slice(words, 1, most).alias("terms"))


def search_lexical(queries: DataFrame, chunks: DataFrame, k: int = rules.MATCHES) -> DataFrame:
    """(org_id, query_id, chunk_id, matches, score, rank): the k best chunks of the tenant that hold any term.

    queries(org_id, query_id, terms), chunks(org_id, chunk_id, text, created_at).
    Chunk tokens are counted per chunk before the join by (tenant, token), and only
    ids and counts travel.  Score: a tenth of the matching token occurrences.
    """
    asked = queries.select("org_id", "query_id", F.explode("terms").alias("token"))
    held = chunks.select("org_id", "chunk_id", "created_at", F.explode(_tokens("text")).alias("token")).groupBy("org_id", "chunk_id", "created_at", "token").agg(F.count("*").alias("n"))
    hits = asked.join(held, ["org_id", "token"]).groupBy("org_id", "query_id", "chunk_id", "created_at").agg(F.sum("n").alias("matches"))
    best = Window.partitionBy("org_id", "query_id").orderBy(F.desc("matches"), F.desc("created_at"), "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("org_id", "query_id", "chunk_id", "matches", (F.col("matches") / 10).alias("score"), "rank")


def search_alike(queries: DataFrame, chunks: DataFrame, k: int = rules.MATCHES) -> DataFrame:
    """The rows of search_lexical, for chunks and queries that are often alike, as those of records with fixed fields.

    Chunks of a tenant that hold the asked tokens equally often tie for every query, so none but the k newest of such
    a class can be among a query's k best; queries that ask for the same held tokens have the same answer.  Classes
    are compared, not chunks and queries; of the classes those remain that fewer than k chunks are better than.
    """
    asked = queries.select("org_id", "query_id", F.explode("terms").alias("token"))
    words = asked.select("org_id", "token").distinct()
    held = chunks.select("org_id", "chunk_id", "created_at", F.explode(_tokens("text")).alias("token")).join(large(words), ["org_id", "token"], "left_semi")
    held = held.groupBy("org_id", "chunk_id", "created_at", "token").agg(F.count("*").alias("n"))
    signed = held.groupBy("org_id", "chunk_id", "created_at").agg(F.array_sort(F.collect_list(F.struct("token", "n"))).alias("held"))
    newest = Window.partitionBy("org_id", "held").orderBy(F.desc("created_at"), "chunk_id")
    kept = signed.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k).persist(StorageLevel.MEMORY_AND_DISK)
    classes = kept.groupBy("org_id", "held").agg(F.count("*").alias("size"))
    told = classes.select("org_id", "held", "size", F.inline("held"))
    answered = asked.join(large(told.select("org_id", "token").distinct()), ["org_id", "token"], "left_semi")
    alike = answered.groupBy("org_id", "query_id").agg(F.array_sort(F.collect_list("token")).alias("terms")).persist(StorageLevel.MEMORY_AND_DISK)
    kinds = alike.select("org_id", "terms").distinct()
    pairs = kinds.select("org_id", "terms", F.explode("terms").alias("token")).join(large(told), ["org_id", "token"]).groupBy("org_id", "terms", "held", "size").agg(F.sum("n").alias("matches"))
    kind = Window.partitionBy("org_id", "terms")
    better = F.sum("size").over(kind.orderBy(F.desc("matches"))) - F.sum("size").over(Window.partitionBy("org_id", "terms", "matches"))
    pairs = pairs.withColumn("better", better).where(F.col("better") < k)
    hits = pairs.join(large(kept.drop("place")), ["org_id", "held"]).select("org_id", "terms", "chunk_id", "created_at", "matches")
    ranked = hits.withColumn("rank", F.row_number().over(kind.orderBy(F.desc("matches"), F.desc("created_at"), "chunk_id"))).where(F.col("rank") <= k)
    return alike.join(large(ranked), ["org_id", "terms"]).select("org_id", "query_id", "chunk_id", "matches", (F.col("matches") / 10).alias("score"), "rank")


def best_per_document(matches: DataFrame) -> DataFrame:
    """One chunk for each (query, document), the best; ranks anew over the rest.  matches(query_id, document_id, chunk_id, score)."""
    one = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return matches.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n").withColumn("rank", F.row_number().over(over))


def role_pools(ranked: DataFrame, k: int = rules.POOL) -> DataFrame:
    """The first k of each (query, pool); the pool ``excluded`` is not cut.  ranked(query_id, pool, rank)."""
    place = F.row_number().over(Window.partitionBy("query_id", "pool").orderBy("rank"))
    return ranked.withColumn("place", place).where((F.col("place") <= k) | (F.col("pool") == "excluded"))


def workspace_counts(docs: DataFrame) -> DataFrame:
    """(org_id, documents, indexed, failed, distinct contents) of each tenant."""
    hashed = docs.groupBy("org_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ingestion_status") == "indexed").alias("indexed"), F.count_if(F.col("ingestion_status") == "failed").alias("failed")
    )
    return hashed.groupBy("org_id").agg(F.sum("n").alias("documents"), F.sum("indexed").alias("indexed"), F.sum("failed").alias("failed"), F.count("*").alias("contents"))

"""From lexical hits to matches: current chunks, polarity, roles, scores, pools, locators, checks and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.operators.profiles import rule_table
from docketry.rules import history as rules
from docketry.rules import review as limits


#: Tasks that a common start of terms is dealt to.
PARTS = 16


def current_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks(org_id, history_doc_id, chunk_version, ...) of the latest version of indexed docs(org_id, history_doc_id, ingestion_version, ingestion_status)."""
    live = docs.where("ingestion_status = 'indexed'").groupBy("org_id", "history_doc_id").agg(F.max("ingestion_version").alias("chunk_version"))
    return chunks.join(large(live), ["org_id", "history_doc_id", "chunk_version"], "left_semi")


def capability_polarity(text: Column, pattern: str) -> Column:
    """unknown, present, absent or ambiguous, by the sentences that name the concept."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?:\r?\n)+|(?<=[.!?])\s+"), lambda s: s.rlike(f"(?i){pattern}"))
    denied = F.exists(parts, lambda s: s.rlike(f"(?i){rules.ABSENT}"))
    stated = F.exists(parts, lambda s: ~s.rlike(f"(?i){rules.ABSENT}"))
    return F.when(F.size(parts) == 0, "unknown").when(denied & stated, "ambiguous").when(denied, "absent").otherwise("present")


def polarities(text: Column) -> Column:
    """The polarity of every concept, in the order of the rules."""
    return F.array(*[capability_polarity(text, p) for _, p in rules.CONCEPTS])


def record_role(file_name: Column, title: Column, content: Column, record_type: Column) -> Column:
    """The role of a record: by type, structure, heading and text, in this order."""
    heading = F.lower(F.concat_ws("\n", file_name, title))
    whole = F.lower(F.concat_ws("\n", file_name, title, content))
    typed = F.create_map(*[F.lit(x) for pair in rules.TYPE_ROLES for x in pair])[record_type]
    table = file_name.rlike(r"(?i)\.(?:csv|json)$") | (content.rlike(rules.RECORD_START) & content.rlike(rules.RECORD_FIELD))
    worded = [F.when((heading if where == "heading" else whole).rlike(f"(?i){p}"), F.lit(role)) for role, where, p in rules.ROLE_WORDING]
    return F.coalesce(F.when(whole.rlike(r"\breadme\b"), "dataset_readme"), typed, F.when(table, "product_precedent"), *worded, F.lit("unclassified"))


def described(chunks: DataFrame) -> DataFrame:
    """chunks with hay (lower-case title, file name and content), role, polarities of the concepts and two product kinds; once a chunk, not once a pair."""
    rows = chunks.withColumn("hay", F.lower(F.concat_ws("\n", "title", "file_name", "content")))
    c = F.col("hay")
    return rows.withColumns({
        "role": record_role(F.col("file_name"), F.col("title"), F.col("content"), F.col("record_type")), "polarity": polarities(c),
        "networking": c.rlike(f"(?i){rules.NETWORKING}"), "accelerator": c.rlike(f"(?i){rules.ACCELERATOR}"),
    })


def _held(hay: Column, items: Column) -> Column:
    return F.size(F.filter(items, lambda x: (F.length(x) >= 3) & F.contains(hay, F.lower(x))))


def score_matches(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(org_id, query_id, chunk_id, score, tier, use, role, penalty) of pairs(org_id, query_id, chunk_id, score).

    queries(query_id, text, identifiers, families, facts): the last three are arrays.
    """
    asked = queries.select("query_id", polarities(F.col("text")).alias("current"), F.col("text").rlike(f"(?i){rules.NETWORKING}").alias("asks_networking"), F.col("text").rlike(f"(?i){rules.ACCELERATOR}").alias("asks_accelerator"), "identifiers", "families", "facts")
    # chunks are described that are matched, no others
    chunks = chunks.join(large(pairs.select("org_id", "chunk_id").distinct()), ["org_id", "chunk_id"], "left_semi")
    rows = pairs.withColumnRenamed("score", "base").join(large(asked), "query_id").join(large(described(chunks).select("org_id", "chunk_id", "hay", "role", "polarity", "networking", "accelerator")), ["org_id", "chunk_id"])
    both = F.arrays_zip(F.col("current").alias("c"), F.col("polarity").alias("h"))
    n = {k: _held(F.col("hay"), F.col(k)) for k in ("identifiers", "families", "facts")}
    counts = {
        "n_ids": n["identifiers"], "n_families": n["families"], "n_facts": n["facts"],
        "shared": F.size(F.filter(both, lambda x: (x["c"] == "present") & (x["h"] == "present"))), "blocked": F.size(F.filter(both, lambda x: (x["c"] == "absent") & (x["h"] == "present"))),
        "apart": F.size(F.filter(both, lambda x: (x["c"] != "unknown") & (x["h"] != "unknown") & (x["c"] != x["h"]) & ~((x["c"] == "absent") & (x["h"] == "present")))),
        "other_form": (F.col("asks_networking") & F.col("accelerator")) | (F.col("asks_accelerator") & F.col("networking")),
    }
    rows = rows.withColumns(counts)
    c = F.col
    penalty = F.when(c("other_form"), 10).otherwise(0) + 12 * c("blocked") + 4 * c("apart")
    boost = F.when(c("n_ids") > 0, 6 + c("n_ids")).otherwise(0) + F.when(c("n_families") > 0, 3).otherwise(0) + F.least(F.lit(3.0), c("n_facts") * 0.75) + F.least(F.lit(3.5), c("shared") * 0.65)
    rows = rows.withColumn("penalty", penalty).withColumn("boost", boost)
    tier = F.when(c("n_ids") > 0, "direct").when((c("n_facts") >= 2) | (c("n_families") > 0), "partial").otherwise("weak")
    use = (
        F.when(~c("role").isin(*rules.PRODUCT_ROLES), F.when(c("role").isin("dataset_readme", "administrative"), "irrelevant").otherwise("context"))
        .when((c("blocked") > 0) | (c("penalty") >= 10), "contrast").when(tier == "direct", "precedent").when((tier == "partial") | (c("shared") > 0), "partial_precedent").otherwise("irrelevant")
    )
    return rows.select("org_id", "query_id", "chunk_id", F.round(c("base") + c("boost") - c("penalty"), 4).alias("score"), F.when(c("blocked") > 0, "weak").otherwise(tier).alias("tier"), use.alias("use"), "role", c("penalty").cast("int").alias("penalty"))


def pooled(matches: DataFrame) -> DataFrame:
    """Adds pool: which of the role pools a match belongs to; excluded for administrative or irrelevant ones; null for none."""
    role, use = F.col("role"), F.col("use")
    pools = dict(rules.POOL_ROLES)
    pool = (
        F.when(role.isin(*pools["product_precedents"]) & use.isin("precedent", "partial_precedent", "contrast"), "product_precedents")
        .when((role == "technical_source") & (use != "irrelevant"), "technical_comparisons").when(role == "counsel_guidance", "counsel_guidance")
        .when(role == "internal_policy", "internal_policy").when(role == "regulatory_material", "regulatory_context")
        .when(role.isin("dataset_readme", "administrative", "unclassified") | (use == "irrelevant"), "excluded")
    )
    return matches.withColumn("pool", pool)


def search_keyword(unmatched: DataFrame, chunks: DataFrame, k: int = limits.MATCHES) -> DataFrame:
    """(org_id, query_id, chunk_id, rank): the k newest chunks of the tenant that contain any term; for the few queries without a lexical hit.

    unmatched(org_id, query_id, terms).  The newest of a query are among the newest of its terms, so each term of a
    tenant is looked for once, and only in chunks that hold its first three characters.
    """
    asked = unmatched.select("org_id", "query_id", F.explode("terms").alias("term")).distinct()
    start = F.substring("term", 1, 3).alias("start")
    terms = asked.select("org_id", "term", start).distinct()
    starts = terms.select("start").distinct().agg(F.collect_set("start").alias("starts"))
    rows = chunks.select("org_id", "chunk_id", "created_at", F.lower(F.concat_ws("\n", "title", "file_name", "content")).alias("hay")).crossJoin(F.broadcast(starts))
    rows = rows.select("org_id", "chunk_id", "created_at", "hay", F.explode(F.filter("starts", lambda x: F.contains(F.col("hay"), x))).alias("start"))
    # a start that most chunks of a tenant hold is dealt to several tasks
    rows = rows.withColumn("part", F.pmod(F.hash("chunk_id"), F.lit(PARTS)))
    of = terms.groupBy("org_id", "start").agg(F.collect_list("term").alias("terms")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = rows.join(large(of), ["org_id", "start", "part"]).select("org_id", "chunk_id", "created_at", F.explode(F.filter("terms", lambda t: F.contains(F.col("hay"), t))).alias("term"))
    order = (F.desc("created_at"), "chunk_id")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("org_id", "term").orderBy(*order))).where(F.col("place") <= k)
    rows = asked.join(large(found), ["org_id", "term"]).select("org_id", "query_id", "chunk_id", "created_at").distinct()
    return rows.select("org_id", "query_id", "chunk_id", F.row_number().over(Window.partitionBy("org_id", "query_id").orderBy(*order)).alias("rank")).where(F.col("rank") <= k)


def locate_record(chunks: DataFrame) -> DataFrame:
    """(chunk_id, locator, record_id): the row of a table or the number of a record, and the id that its text names."""
    is_row = (F.col("record_type") == "spreadsheet") | F.col("file_name").rlike(r"(?i)\.csv$")
    locator = F.when(is_row, F.concat(F.lit("CSV row "), (F.col("chunk_ordinal") + 2).cast("string"))).otherwise(F.concat(F.lit("record "), (F.col("chunk_ordinal") + 1).cast("string")))
    return chunks.select("chunk_id", is_row.alias("is_row"), locator.alias("locator"), F.trim(F.regexp_extract("content", rules.RECORD_ID, 1)).alias("record_id"), "content")


def check_projection(matches: DataFrame, located: DataFrame) -> DataFrame:
    """(query_id, chunk_id, code): matches(query_id, chunk_id, pool, role) in a pool that doesn't take their role, and table rows with several record ids."""
    allowed = rule_table(matches.sparkSession, [(p, r, True) for p, roles in rules.POOL_ROLES[:4] for r in (*roles, *(("classification_memo", "product_precedent", "review_worksheet") if p == "technical_comparisons" else ()))], "pool string, role string, allowed boolean")
    pools = [p for p, _ in rules.POOL_ROLES[:4]]
    rows = matches.where(F.col("pool").isin(*pools)).join(allowed, ["pool", "role"], "left").join(large(located), "chunk_id")
    codes = F.array_compact(F.array(
        F.when(F.col("allowed").isNull(), F.lit("HISTORY_ROLE_SECTION_MISMATCH")),
        F.when(F.col("is_row") & (F.regexp_count("content", F.lit(rules.RECORD_IDS)) > 1), F.lit("STRUCTURED_HISTORY_RECORD_LEAKAGE")),
        F.when(F.col("is_row") & (F.col("record_id") != "") & ~F.contains(F.lower("content"), F.lower("record_id")), F.lit("STRUCTURED_HISTORY_LOCATOR_MISMATCH")),
    ))
    return rows.select("query_id", "chunk_id", F.explode(codes).alias("code"))


def history_signals(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, codes): the distinct control codes of each match's title, file name and content, sorted; for priority only."""
    text = F.concat_ws(" ", "title", "file_name", "content")
    chunks = chunks.join(large(matches.select("chunk_id").distinct()), "chunk_id", "left_semi")
    codes = chunks.select("chunk_id", F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rules.HISTORY_CODE), F.lit(0)))).alias("codes"))
    return matches.select("query_id", "chunk_id").join(large(codes), "chunk_id").select("query_id", "chunk_id", "codes")


def retrieval_trace(queries: DataFrame, chunks: DataFrame, matches: DataFrame, n: int = rules.TRACE) -> DataFrame:
    """(query_id, chunks_before, candidates, top): how many chunks the tenant has, how many matched, and the best n of them."""
    before = chunks.groupBy("org_id").agg(F.count("*").alias("chunks_before"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    best = matches.withColumn("place", place)
    top = best.groupBy("query_id").agg(F.count("*").alias("candidates"), F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.struct("place", "chunk_id")))).alias("t"))
    rows = queries.select("org_id", "query_id").join(before, "org_id", "left").join(large(top), "query_id", "left")
    return rows.select("query_id", F.coalesce("chunks_before", F.lit(0)).alias("chunks_before"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce(F.col("t.chunk_id"), F.array().cast("array<bigint>")).alias("top"))


def history_detail(docs: DataFrame, chunks: DataFrame, n: int = 20) -> DataFrame:
    """(org_id, history_doc_id, place, chunk_id): the first n chunks of each document, newest version first."""
    place = F.row_number().over(Window.partitionBy("org_id", "history_doc_id").orderBy(F.desc("chunk_version"), "chunk_ordinal", "chunk_id"))
    return docs.select("org_id", "history_doc_id").distinct().join(large(chunks), ["org_id", "history_doc_id"]).withColumn("place", place).where(F.col("place") <= n).select("org_id", "history_doc_id", "place", "chunk_id")

"""Records of structured history documents, the router between JSON, CSV and prose, and ingestion as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.operators import facts as fx
from docketry.operators import history as hs
from docketry.rules import identity
from docketry.rules import review as rules

_LINE, _CELL = "\x1e", "\x1f"


def normalized(text: Column) -> Column:
    """Line ends as \\n, ends trimmed; null is empty."""
    return F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit(hs.WHITE))


def csv_rows(body: Column) -> Column:
    """The rows of a quoted CSV text as arrays of trimmed cells; rows without any content are left out.

    Every odd part between quotes is quoted; an empty part between two quoted ones is
    a quote itself.  So one split of the text does, whatever its length.  U+001E and
    U+001F count as a line end and a comma; a quote that is never closed runs to the end.
    """
    parts = F.split(F.replace(body, F.lit("\r"), F.lit("")), '"')
    last = F.size(parts) - 1
    outer = lambda p, i: F.when((p == "") & (i > 0) & (i < last), '"').otherwise(F.translate(p, ",\n", _CELL + _LINE))
    marked = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(outer(p, i))), "")
    rows = F.transform(F.split(marked, _LINE), lambda r: F.transform(F.split(r, _CELL), lambda c: F.trim(c, F.lit(hs.WHITE))))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def csv_records(body: Column) -> Column:
    """One ``header: value`` text a row; null unless there are two rows and two cells in the first."""
    rows = csv_rows(body)
    heads = F.transform(rows[0], lambda h, i: F.when(h == "", F.concat(F.lit("column_"), i + 1)).otherwise(h))
    told = lambda row: F.array_join(F.transform(heads, lambda h, i: F.concat(h, F.lit(": "), F.coalesce(F.get(row, i), F.lit("")))), "\n")
    return F.when((F.size(rows) >= 2) & (F.size(rows[0]) >= 2), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), told))


def json_records(body: Column) -> Column:
    """The compact JSON of each record: an array's elements, those of an object's first array, or the object itself.

    Keys keep their order and numbers their spelling.  Null if the text is no JSON
    array or object, or gives no record; a text with a key twice is no JSON here.
    """
    # the text is whole if it is one value in an array and in an object alike
    whole = (F.coalesce(F.size(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).cast("array<variant>")), F.lit(0)) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), body, F.lit("}"))).isNotNull()
    first = F.substring(body, 1, 1)
    kinds = F.try_parse_json(body).cast("map<string,variant>")
    lists = F.filter(F.map_entries(F.from_json(body, "map<string,string>")), lambda e: F.startswith(F.schema_of_variant(kinds[e["key"]]), F.lit("ARRAY")))
    items = F.when(first == "[", body).otherwise(F.coalesce(F.get(lists, F.lit(0))["value"], F.concat(F.lit("["), body, F.lit("]"))))
    kind = F.transform(F.try_parse_json(items).cast("array<variant>"), lambda v: F.schema_of_variant(v))
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    told = F.zip_with(F.from_json(items, "array<string>"), kind, lambda s, k: F.when(s.isNull(), "null").when(k == "STRING", quoted(s)).otherwise(s))
    return F.when(first.isin("[", "{") & whole, F.when(F.size(told) > 0, told))


def _spread(docs: DataFrame, records: Column) -> DataFrame:
    """One row a record with its offsets: records stand behind each other, one character apart."""
    rows = docs.select("history_doc_id", F.posexplode(records).alias("ordinal", "content"))
    so_far = Window.partitionBy("history_doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(so_far), F.lit(0)).cast("int")
    return rows.withColumn("char_start", start).select("history_doc_id", "ordinal", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), "content", F.sha2("content", 256).alias("content_hash"))


def explode_csv(docs: DataFrame) -> DataFrame:
    """docs(history_doc_id, text) to chunks of one row each; documents that are no CSV give none."""
    return _spread(docs, csv_records(normalized(F.col("text"))))


def explode_json(docs: DataFrame) -> DataFrame:
    """docs(history_doc_id, text) to chunks of one record each; documents that are no JSON give none."""
    return _spread(docs, json_records(normalized(F.col("text"))))


def records_of(text: Column) -> Column:
    body = normalized(text)
    return F.coalesce(json_records(body), csv_records(body))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of docs(history_doc_id, text): JSON records, else CSV rows, else overlapping prose."""
    parted = docs.select("history_doc_id", "text", records_of(F.col("text")).alias("records"))
    return _spread(parted.where("records IS NOT NULL"), F.col("records")).unionByName(hs.chunk_text(parted.where("records IS NULL").select("history_doc_id", "text")))


def ingested(docs: DataFrame, most: int = rules.MAX_TEXT_CHARS) -> DataFrame:
    """docs(org_id, history_doc_id, text, created_at, ingestion_status, attempt_count) with the outcome of those that are queued.

    A content that the tenant has already is a duplicate; a text that is null, blank or over ``most`` characters fails
    with a code; all others are indexed.  Rows that aren't queued stay as they are.  No row fails the job.
    """
    queued = F.col("ingestion_status") == "queued"
    code = F.when(F.col("text").isNull(), "TEXT_EXTRACTION_FAILED").when((normalized(F.col("text")) == "") | (F.length("text") > most), "INGESTION_FAILED")
    marked = hs.mark_duplicates(docs).withColumn("error_code", F.when(queued & F.col("duplicate_of").isNull(), code))
    outcome = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("error_code").isNotNull(), "failed").otherwise("indexed")
    return marked.withColumn("attempt_count", F.col("attempt_count") + F.when(queued & F.col("duplicate_of").isNull(), 1).otherwise(0)).withColumn("ingestion_status", F.when(queued, outcome).otherwise(F.col("ingestion_status")))


def ingest_history(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their outcome, and the chunks and markers of those that were queued and are now indexed."""
    done = ingested(docs)
    fresh = done.where("ingestion_status = 'indexed'").join(large(docs.where("ingestion_status = 'queued'").select("history_doc_id")), "history_doc_id", "left_semi").select("history_doc_id", "text")
    return done, chunk_documents(fresh), fx.extract_markers(fresh.withColumnRenamed("history_doc_id", "doc_id"))


def budget_text(docs: DataFrame, most: int, headings: tuple[str, ...] = identity.HEADINGS) -> DataFrame:
    """(doc_id, text): whole texts up to ``most`` characters; of longer ones the first third, windows round headings, and the end.

    Windows are taken in the order of the headings, each round its first place, unless they touch one taken before.
    A text is searched once a heading and cut once a window, so the work is in proportion to its length.
    """
    text, width = F.col("body"), max(identity.LEAST_WINDOW, most // 18)
    size = F.length("body")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("low", F.lower("body"))
    places = F.filter(F.array(*[F.instr("low", h) - 1 for h in headings]), lambda p: p >= 0)
    windows = F.transform(places, lambda p: F.struct(F.greatest(F.lit(0), p - width // 3).alias("start"), F.least(size, p + width).alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    free = lambda taken, w: ~F.exists(taken, lambda t: (w["stop"] >= t["start"]) & (w["start"] <= t["stop"]))
    taken = F.aggregate(windows, none, lambda made, w: F.when(free(made, w), F.concat(made, F.array(w))).otherwise(made))
    parts = F.concat(F.array(F.substring("body", 1, most // 3)), F.transform(taken, lambda w: F.substring(text, w["start"] + 1, w["stop"] - w["start"])))
    rows = rows.withColumn("joined", F.when(size > most, F.array_join(parts, identity.EXCERPT)))
    left = F.lit(most) - F.length("joined")
    tail = F.when(left > identity.LEAST_TAIL, F.right(text, F.least(left, F.lit(most // 8)))).otherwise("")
    long = F.when(left < 0, F.substring("joined", 1, most)).otherwise(F.substring(F.concat("joined", F.lit(identity.CLOSING), tail), 1, most))
    return rows.select("doc_id", F.when(size <= most, text).otherwise(long).alias("text"))

"""Registered queries of structured chunks, ingestion, logical lines and entities, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import views
from docketry.operators import chunking as ch
from docketry.operators import entities as en
from docketry.oracles import STEPS, text
from docketry.registry import joined, query
from docketry.registry_checks import _RELATION
from docketry.rules import checks as cr

#: History files for each part: JSON arrays and objects, quoted CSV, broken JSON, prose and blanks, some twice.
_FILES = """SELECT 'org' || CAST(p_partkey % 5 AS VARCHAR(4)) AS org_id, CAST(p_partkey AS BIGINT) AS history_doc_id, CAST(p_partkey AS BIGINT) AS created_at,
  CASE p_partkey % 5 WHEN 4 THEN 'indexed' ELSE 'queued' END AS ingestion_status, CAST(p_partkey % 3 AS INTEGER) AS attempt_count,
  CASE p_partkey % 9 WHEN 0 THEN '[{"product": "SX' || p_partkey || '", "size": ' || p_size || ', "tags": [1, "a b"]}, "' || p_brand || '", null, ' || p_size || ', {"code": "5A002"}]'
    WHEN 1 THEN '{"source": "memo", "rows": [{"name": "' || p_name || '", "ok": true}, {"name": null}], "more": [1]}' WHEN 2 THEN ' {"single": {"part": "SX' || p_partkey || '", "code": "3A001.b"}} '
    WHEN 3 THEN 'product,,note' || chr(13) || chr(10) || 'SX' || p_partkey || ',"a, b",' || p_size || chr(10) || ',,' || chr(10) || '"two' || chr(10) || 'lines",x' || chr(10) || 'last,"say ""hi"" once",z'
    WHEN 4 THEN '{"broken": ' || p_size || chr(10) || 'record_id: R' || p_partkey || ' under 5A991' WHEN 5 THEN 'only, one line of ' || p_name WHEN 6 THEN '  ' WHEN 7 THEN 'Model SX' || (p_partkey % 10) || ' under 3A001' ELSE '[]' END AS text FROM part"""
_LINES = """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE p_partkey % 10 WHEN 9 THEN 'README.md' ELSE 'file.txt' END AS file_name,
  CASE p_partkey % 7 WHEN 0 THEN 'Overview' || chr(10) || 'Prior record | Product | Memory' || chr(10) || '--- | :-- | ---' || chr(10) || 'CASE-' || (1000 + p_partkey % 9000) || ' | AX' || (p_partkey % 50) || '0 card | 16 GB HBM3' || chr(10) || '| | BX' || (p_partkey % 30) || '0 board | 32 GB'
    WHEN 1 THEN 'Item,Model,Throughput' || chr(10) || '7,QX' || p_partkey || ',10 Gbps' || chr(10) || '8,QY' || (p_partkey % 9) || '1' || chr(10) || 'Ethernet interface, plain' WHEN 2 THEN 'Product: NX' || p_partkey || ' gateway' || chr(10) || 'Processor: ARM Cortex-A53' || chr(10) || 'Memory: 8 GB' || chr(10) || 'Prior record: CASE-' || (100 + p_partkey % 800)
    WHEN 3 THEN '1. AB' || p_partkey || ' gateway should match MEMO-12' || chr(10) || '2. CD' || (p_partkey % 40) || '7 switch: expected result' || chr(10) || '3) EF' || (p_partkey % 60) || '2 router with ab1 or EF99' WHEN 4 THEN 'Module GX' || p_partkey || ' datasheet' || chr(10) || 'Ethernet interface'
    WHEN 5 THEN 'Contains HX' || p_partkey || ' module' || chr(10) || 'Model | note' || chr(10) || 'no table' ELSE 'Notes' || chr(10) || 'plain' END || chr(10)
  || CASE p_partkey % 8 WHEN 0 THEN 'Includes module ZZ' || (p_partkey % 90) WHEN 1 THEN 'Replaces AX' || (p_partkey % 50) || '0' WHEN 2 THEN 'Competing product CX9 and CX8' WHEN 3 THEN 'Compared with EX7 and EX7' WHEN 4 THEN 'Firmware: FW77 signed' WHEN 5 THEN 'Uses JESD204 and DX8' WHEN 6 THEN 'Outside counsel' ELSE 'Internal policy' END || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN '- KX' || (p_partkey % 20) || ' sensor 5 V' WHEN 1 THEN 'LX' || (p_partkey % 20) || ' device' ELSE 'Installation of MX4' END AS text FROM part"""
_CELL = "trim(replace(replace(replace(replace({0}, '\"\"', chr(1)), '\"', ''), chr(1), '\"'), chr(13), ''), ' ' || chr(9) || chr(10))"
_PARTED = "[trim(c) for c in string_split(regexp_replace(trim({0}), '^\\|+|\\|+$', '', 'g'), {1})]"
STEPS.update({
    "files": _FILES,
    "bodies": "SELECT org_id, history_doc_id, trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10)) AS body FROM files",
    "json_items": """SELECT history_doc_id, CASE WHEN json_type(body) = 'ARRAY' THEN CAST(CAST(body AS JSON) AS JSON[]) WHEN json_type(json_extract(body, '$.rows')) = 'ARRAY' THEN CAST(json_extract(body, '$.rows') AS JSON[]) ELSE [CAST(body AS JSON)] END AS items
        FROM bodies WHERE json_valid(body) AND json_type(body) IN ('ARRAY', 'OBJECT')""",
    "json_told": "SELECT history_doc_id, ordinal, CASE WHEN item IS NULL THEN 'null' ELSE CAST(json(item) AS VARCHAR) END AS content FROM (SELECT history_doc_id, unnest(range(len(items))) AS ordinal, unnest(items) AS item FROM json_items)",
    "csv_rows": f"""SELECT *, row_number() OVER (PARTITION BY history_doc_id ORDER BY at_) - 1 AS no_ FROM (SELECT history_doc_id, at_, [{_CELL.format('c')} for c in regexp_extract_all(row_ || ',', '((?:"[^"]*"|[^",])*),', 1)] AS cells FROM (SELECT history_doc_id, unnest(range(len(r))) AS at_, unnest(r) AS row_
        FROM (SELECT history_doc_id, regexp_extract_all(body, '(?:"[^"]*"|[^"\\n])+') AS r FROM bodies WHERE NOT (json_valid(body) AND left(body, 1) IN ('[', '{{') AND body <> '[]')))) WHERE len([c for c in cells if c <> '']) > 0""",
    "csv_heads": "SELECT history_doc_id, cells AS heads FROM csv_rows WHERE no_ = 0 AND len(cells) > 1 AND history_doc_id IN (SELECT history_doc_id FROM csv_rows WHERE no_ = 1)",
    "csv_told": "SELECT history_doc_id, no_ - 1 AS ordinal, array_to_string([(CASE WHEN heads[i] = '' THEN 'column_' || i ELSE heads[i] END) || ': ' || coalesce(cells[i], '') for i in range(1, len(heads) + 1)], chr(10)) AS content FROM csv_rows JOIN csv_heads USING (history_doc_id) WHERE no_ > 0",
    "prose_told": "SELECT history_doc_id, 0 AS ordinal, body AS content FROM bodies WHERE body <> '' AND history_doc_id NOT IN (SELECT history_doc_id FROM json_told UNION ALL SELECT history_doc_id FROM csv_told)",
    "hashed_files": "SELECT *, min(history_doc_id) OVER (PARTITION BY org_id, sha256(text)) AS earliest FROM files",
    "done_files": """SELECT history_doc_id, CASE WHEN ingestion_status <> 'queued' THEN ingestion_status WHEN earliest <> history_doc_id THEN 'duplicate' WHEN trim(text) = '' THEN 'failed' ELSE 'indexed' END AS ingestion_status,
        CASE WHEN ingestion_status = 'queued' AND earliest = history_doc_id AND trim(text) = '' THEN 'INGESTION_FAILED' END AS error_code, CAST(attempt_count + CASE WHEN ingestion_status = 'queued' AND earliest = history_doc_id THEN 1 ELSE 0 END AS INTEGER) AS attempt_count, ingestion_status = 'queued' AS asked FROM hashed_files""",
    "intake_docs": _LINES,
    "raw_lines": f"""SELECT *, CASE WHEN contains(line, '|') THEN '|' WHEN contains(line, ',') THEN ',' ELSE '' END AS mark, len({_PARTED.format('line', text('|'))}) AS pipes, len({_PARTED.format('line', text(','))}) AS commas FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM intake_docs))""",
    "could_head": f"""SELECT *, mark <> '' AND regexp_matches(line, {text(cr.TABLE_SUBJECT)}) AND CASE WHEN mark = '|' AND regexp_full_match(next1, '[\\s|:-]+') THEN contains(next2, mark) AND len({_PARTED.format('next2', 'mark')}) = pipes ELSE contains(next1, mark) AND len({_PARTED.format('next1', 'mark')}) = CASE mark WHEN '|' THEN pipes ELSE commas END END AS heads
        FROM (SELECT *, lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS next1, lead(line, 2, '') OVER (PARTITION BY doc_id ORDER BY i) AS next2 FROM raw_lines)""",
    "walked": """WITH RECURSIVE w AS (SELECT doc_id, i, line, CASE WHEN heads THEN i ELSE -1 END AS head, line AS top, CASE mark WHEN '|' THEN pipes ELSE commas END AS width, mark, heads AS gone FROM could_head WHERE i = 0 UNION ALL
        SELECT c.doc_id, c.i, c.line, CASE WHEN inside OR ruled THEN w.head WHEN c.heads THEN c.i ELSE -1 END, CASE WHEN inside OR ruled THEN w.top ELSE c.line END, CASE WHEN inside OR ruled THEN w.width WHEN c.mark = '|' THEN c.pipes ELSE c.commas END, CASE WHEN inside OR ruled THEN w.mark ELSE c.mark END, ruled OR (NOT inside AND c.heads)
        FROM w JOIN could_head c ON c.doc_id = w.doc_id AND c.i = w.i + 1, LATERAL (SELECT w.head = w.i AND w.mark = '|' AND w.head >= 0 AND regexp_full_match(c.line, '[\\s|:-]+') AS ruled) x, LATERAL (SELECT NOT ruled AND w.head >= 0 AND contains(c.line, w.mark) AND w.width = CASE w.mark WHEN '|' THEN c.pipes ELSE c.commas END AS inside) y) SELECT * FROM w""",
    "lines_told": f"""SELECT doc_id, i + 1 AS line_no, 0 AS place, line FROM walked WHERE head < 0 UNION ALL SELECT doc_id, i + 1, row_number() OVER (PARTITION BY doc_id, i ORDER BY j <> s, j) - 1, name || ': ' || cell || ' [row:' || (i + 1) || ']' FROM (
        SELECT doc_id, i, s, unnest(range(1, len(hs) + 1)) AS j, unnest(hs) AS name, unnest(cs) AS cell FROM (SELECT *, list_position([regexp_matches(h, {text(cr.TABLE_SUBJECT)}) for h in hs], true) AS s FROM (SELECT doc_id, i, {_PARTED.format('top', 'mark')} AS hs, {_PARTED.format('line', 'mark')} AS cs FROM walked WHERE head >= 0 AND NOT gone))) WHERE cell <> ''""",
    "keyed_lines": f"""SELECT *, CASE WHEN key = '' THEN line ELSE regexp_extract(line, {text(cr.KEYED)}, 2) END AS v FROM (SELECT *, regexp_extract(line, {text(cr.KEYED)}, 1) AS key FROM (SELECT doc_id, line_no, place, line AS raw, trim(regexp_replace(line, {text(cr.LISTED)}, '')) AS line FROM lines_told)) WHERE line <> ''""",
    "listed_items": f"""SELECT *, CASE WHEN spec THEN [v] WHEN regexp_matches(key, {text(cr.HISTORY_CUE)}) AND len(found) = 0 THEN regexp_extract_all(v, {text(cr.HISTORY_ID_WITHIN)}) ELSE found END AS items FROM (
        SELECT *, regexp_matches(v, {text(cr.SPECIFICATION)}) AND (regexp_matches(key, {text(cr.ATTRIBUTE_KEY)}) OR NOT regexp_matches(v, {text(cr.PRODUCT_CUE)})) AS spec, [x for x, n in regexp_extract_all(v, {text(cr.PART_OR_MODEL)}) if list_position(regexp_extract_all(v, {text(cr.PART_OR_MODEL)}), x) = n] AS found FROM keyed_lines)""",
    "said_items": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, place, at_) AS n, lower(m) AS low, {_RELATION} AS wording, CASE WHEN spec THEN 'a' WHEN regexp_matches(m, {text(cr.NON_PRODUCT)}) THEN 'a' WHEN regexp_matches(m, {text(cr.HISTORY_ID)}) OR (regexp_matches(key, {text(cr.HISTORY_CUE)}) AND regexp_matches(m, {text(cr.RECORD_NUMBER)})) THEN 'h'
        WHEN regexp_full_match(m, {text(cr.SPECIFICATION)}) OR regexp_matches(key, {text(cr.ATTRIBUTE_KEY)}) THEN 'a' ELSE 'p' END AS sort FROM (SELECT *, unnest(range(len(items))) AS at_, unnest(items) AS m FROM listed_items)""",
    "placed_items": f"""SELECT *, CASE WHEN makes THEN row_number() OVER (PARTITION BY doc_id, low, makes ORDER BY n) END AS nth FROM (SELECT *, sort = 'p' AND (inside OR wording <> 'unknown') AS makes FROM (SELECT *, sort = 'p' AND (regexp_matches(line, {text(cr.PRODUCT_CUE)}) OR (line_no <= 2 AND NOT regexp_matches(line, {text(cr.REFERENCE)}))) AS inside FROM said_items))""",
    "subjects": f"""SELECT *, could AND (own OR count(*) FILTER (could) OVER (PARTITION BY doc_id ORDER BY n) = 1) AS subject FROM (SELECT *, coalesce(nth, 0) = 1 AND inside AND (own OR wording = 'included_component') AS could FROM (
        SELECT *, wording = 'unknown' OR (wording IN ('history_reference', 'comparison_reference', 'instruction_reference') AND regexp_matches(raw, {text(cr.ENUMERATED)}) AND len(items) = 1) AS own FROM placed_items))""",
    "held_by": "SELECT *, CASE WHEN NOT inside THEN last_value(CASE WHEN subject THEN low END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent, CASE WHEN subject THEN CASE WHEN count(*) FILTER (subject) OVER (PARTITION BY doc_id ORDER BY n) = 1 THEN 'primary_subject' ELSE 'secondary_subject' END ELSE wording END AS tie FROM subjects",
    "entity_rows": """SELECT h.doc_id, h.n, 'product' AS entity_type, h.low AS entity, tie AS relation, parent, h.line_no, s.spans, subject AS eligible FROM held_by h JOIN (SELECT doc_id, low, list(line_no ORDER BY n) AS spans FROM held_by WHERE makes AND (inside OR nth = 1) GROUP BY doc_id, low) s ON s.doc_id = h.doc_id AND s.low = h.low WHERE nth = 1 UNION ALL
        SELECT doc_id, n, CASE sort WHEN 'h' THEN 'history_record' WHEN 'a' THEN 'technical_attribute' ELSE 'unknown' END, m, CASE sort WHEN 'h' THEN 'history_reference' WHEN 'a' THEN 'technical_attribute' ELSE 'administrative_context' END, parent, line_no, [line_no], false FROM held_by WHERE NOT makes""",
    "owned_rows": f"""SELECT e.doc_id, e.entity, e.relation, CAST(CASE WHEN eligible THEN len(list_distinct(list_concat(spans, coalesce(a.held, [])))) ELSE coalesce(len(list_distinct(a.held)), 0) END AS INTEGER) AS owned, coalesce(len(a.held), 0) AS attributes,
        len([s for s in regexp_extract_all(text, {text(cr.SECTION)}, 1) if regexp_matches(s, '(?i)\\b' || e.entity || '\\b')]) > 0 AS own_section, eligible AS classifiable FROM entity_rows e JOIN intake_docs d ON d.doc_id = e.doc_id
        LEFT JOIN (SELECT doc_id, parent, list(line_no) AS held FROM entity_rows WHERE entity_type = 'technical_attribute' GROUP BY doc_id, parent) a ON a.doc_id = e.doc_id AND a.parent = e.entity WHERE entity_type = 'product'""",
    "doc_roles": f"SELECT doc_id, text, CASE WHEN regexp_matches(text, {text(cr.INSTRUCTION)}) AND (contains(lower(file_name), 'readme') OR contains(lower(text), 'test') OR contains(lower(text), 'expected')) THEN 'test_manifest' "
        + " ".join(f"WHEN regexp_matches(lower(text), {text(p)})" + (f" AND NOT regexp_matches(lower(text), {text(o)})" if o else "") + f" THEN {text(r)}" for r, p, o in cr.DOCUMENT_ROLES) + " ELSE 'unknown' END AS role FROM intake_docs",
    "states": f"""SELECT doc_id, role, products, mentions, history, comparisons, CASE WHEN products > 1 THEN 'multi_entity_requires_segmentation' WHEN products = 1 THEN CASE WHEN attributes >= 2 OR (regexp_matches(text, {text(cr.TECHNICAL)}) AND (attributes > 0 OR regexp_matches(text, {text(cr.CONTAINMENT)}) OR regexp_matches(text, {text(cr.SOURCE_WORDS)}))) THEN 'single_product_classifiable' ELSE 'single_product_insufficient_evidence' END
        WHEN role IN ('test_manifest', 'readme', 'internal_policy', 'counsel_guidance') THEN 'non_product_context' ELSE 'insufficient_product_evidence' END AS state FROM (SELECT r.doc_id, role, text, count(*) FILTER (classifiable) AS products, count(o.doc_id) AS mentions, count(*) FILTER (relation = 'history_reference') AS history, count(*) FILTER (relation = 'comparison_reference') AS comparisons, coalesce(sum(attributes) FILTER (classifiable), 0) AS attributes
        FROM doc_roles r LEFT JOIN owned_rows o ON o.doc_id = r.doc_id GROUP BY r.doc_id, role, text)""",
    "qualified_docs": """SELECT doc_id, CASE WHEN role = 'unknown' OR (state = 'single_product_insufficient_evidence' AND role IN ('test_manifest', 'readme')) THEN CASE state WHEN 'multi_entity_requires_segmentation' THEN 'multi_product_catalog' WHEN 'single_product_classifiable' THEN 'single_product_technical_source' WHEN 'single_product_insufficient_evidence' THEN 'product_intake' ELSE 'unknown' END ELSE role END AS role,
        state, products, mentions, history, comparisons FROM states""",
})
_OFFSETS = "SELECT history_doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(stop - length(content) - 1 AS INTEGER) AS char_start, CAST(stop - 1 AS INTEGER) AS char_end, content, sha256(content) AS content_hash FROM (SELECT *, sum(length(content) + 1) OVER (PARTITION BY history_doc_id ORDER BY ordinal) AS stop FROM ({0}))"
_ALL = "SELECT * FROM json_told UNION ALL SELECT * FROM csv_told UNION ALL SELECT * FROM prose_told"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return spark.sql(_FILES)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.views(spark, sf_dir, "part")
    return spark.sql(_LINES)


@query("explode_json", _OFFSETS.format("SELECT * FROM json_told"))
def explode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.explode_json(_files(spark, sf_dir))


@query("explode_csv", _OFFSETS.format("SELECT * FROM csv_told"))
def explode_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return ch.explode_csv(files.where(ch.json_records(ch.normalized(F.col("text"))).isNull()))


@query("chunk_documents", _OFFSETS.format(_ALL))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_documents(_files(spark, sf_dir))


@query("ingest_history", "SELECT history_doc_id, ingestion_status, error_code, attempt_count FROM done_files")
def ingest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.ingest_history(_files(spark, sf_dir))[0].select("history_doc_id", "ingestion_status", "error_code", "attempt_count")


@query("ingested_chunks", _OFFSETS.format(_ALL) + " WHERE history_doc_id IN (SELECT history_doc_id FROM done_files WHERE asked AND ingestion_status = 'indexed')")
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.ingest_history(_files(spark, sf_dir))[1]


@query("logical_lines", "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(place AS INTEGER) AS place, line FROM lines_told")
def logical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.logical_lines(_docs(spark, sf_dir))


@query("resolve_entities", "SELECT doc_id, CAST(n AS INTEGER) AS n, entity_type, entity, relation, parent, CAST(line_no AS INTEGER) AS line_no, array_to_string(spans, '|') AS spans, eligible FROM entity_rows")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(en.resolve_entities(_docs(spark, sf_dir)).withColumn("spans", F.col("spans").cast("array<string>")), "spans")


@query("owned_evidence", "SELECT * FROM owned_rows")
def owned_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return en.owned_evidence(en.resolve_entities(docs), docs)


def _qualified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = en.resolve_entities(docs)
    return en.qualify(docs, en.owned_evidence(found, docs)), found


@query("qualify", "SELECT * FROM qualified_docs")
def qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qualified(_docs(spark, sf_dir))[0]


@query("route_documents", "SELECT doc_id, role FROM qualified_docs WHERE state = 'single_product_classifiable'")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.route_documents(_qualified(_docs(spark, sf_dir))[0])[0].select("doc_id", "role")


@query("intake_reports", """SELECT q.doc_id, '## Document qualification' || chr(10) || '- Document role: ' || role || chr(10) || '- Classifiability: ' || state || chr(10) || '## Detected product entities' || chr(10) || coalesce(s.told, '- No coherent product entity was detected.') || chr(10) || '## Attached context' || chr(10) || coalesce(c.told, '- No entity-scoped technical attributes were retained.') AS report FROM qualified_docs q
    LEFT JOIN (SELECT doc_id, string_agg(place || '. ' || upper(entity) || ' - ' || relation, chr(10) ORDER BY n) AS told FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM entity_rows WHERE entity_type = 'product' AND eligible) GROUP BY doc_id) s ON s.doc_id = q.doc_id
    LEFT JOIN (SELECT doc_id, string_agg(CASE entity_type WHEN 'history_record' THEN '- Internal history reference: ' ELSE '- Technical attribute: ' END || entity, chr(10) ORDER BY n) AS told FROM entity_rows WHERE entity_type IN ('history_record', 'technical_attribute') GROUP BY doc_id) c ON c.doc_id = q.doc_id WHERE state <> 'single_product_classifiable'""")  # fmt: skip
def intake_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    qualified, found = _qualified(_docs(spark, sf_dir))
    return en.intake_reports(en.route_documents(qualified)[1], found)

"""Products of a document: logical lines, entities and what they own, qualification and routing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.joins import large
from docketry.operators import checks as ck
from docketry.rules import checks as rules

PLAIN, CONSUMED = -1, -2


def table_heads(lines: list[str]) -> list[int]:
    """For each line the index of its table's head, PLAIN outside tables, CONSUMED for heads and the rules below them.

    A head names a product in a cell and stands above at least one row of as many cells.
    """
    parted = lambda line, mark: [c.strip() for c in line.strip().strip("|").split(mark)]
    out, head, mark, width = [], None, "", 0
    for i, line in enumerate(lines):
        if head is not None:
            if mark in line and len(parted(line, mark)) == width:
                out.append(CONSUMED if ruled == i else head)
                continue
            if ruled == i:
                out.append(CONSUMED)
                continue
            head = None
        mark = "|" if "|" in line else "," if "," in line else ""
        cells = parted(line, mark) if mark else []
        if any(re.search(rules.TABLE_SUBJECT, c) for c in cells):
            ruled = i + 1 if mark == "|" and i + 1 < len(lines) and re.fullmatch(r"[\s|:-]+", lines[i + 1]) else -1
            row = lines[i + (2 if ruled >= 0 else 1) :][:1]
            if row and mark in row[0] and len(parted(row[0], mark)) == len(cells):
                head, width = i, len(cells)
                out.append(CONSUMED)
                continue
        out.append(PLAIN)
    return out


def _heads(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda lines: table_heads(list(lines)))


def logical_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, place, line): rows of Markdown and CSV tables as ``head: value [row:n]`` lines, the product's cell first; all other lines as they are.

    Line numbers start at 1.  Where tables stand is found line by line in a small helper; null is a text without lines.
    """
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    rows = docs.select("doc_id", lines.alias("lines")).withColumn("heads", F.pandas_udf(_heads, "array<int>")("lines"))

    def cells(line: Column, comma: Column) -> Column:
        bare = F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")
        return F.transform(F.when(comma, F.split(bare, ",")).otherwise(F.split(bare, r"\|")), lambda c: F.trim(c))

    def told(line: Column, i: Column) -> Column:
        top = F.get(F.col("lines"), F.get(F.col("heads"), i))
        comma = ~F.contains(top, F.lit("|"))
        names, values = cells(top, comma), cells(line, comma)
        subject = F.array_position(F.transform(names, lambda c: c.rlike(rules.TABLE_SUBJECT)), True).cast("int") - 1
        order = F.concat(F.array(subject), F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda j: j != subject))
        mark = F.concat(F.lit(" [row:"), (i + 1).cast("string"), F.lit("]"))
        return F.transform(F.filter(order, lambda j: F.get(values, j) != ""), lambda j: F.concat(F.get(names, j), F.lit(": "), F.get(values, j), mark))

    none = F.array().cast("array<string>")
    each = F.transform("lines", lambda line, i: F.when(F.get(F.col("heads"), i) == PLAIN, F.array(line)).when(F.get(F.col("heads"), i) == CONSUMED, none).otherwise(told(line, i)))
    spread = rows.select("doc_id", F.posexplode(each).alias("i", "told"))
    return spread.select("doc_id", (F.col("i") + 1).alias("line_no"), F.posexplode("told").alias("place", "line"))


def typed_mentions(lines: DataFrame) -> DataFrame:
    """(doc_id, n, line_no, raw, line, mention, kind, alone): identifiers of logical lines in order, and specification values as wholes.  n counts the mentions of a document."""
    line = F.trim(F.regexp_replace("raw", rules.LISTED, ""))
    rows = lines.withColumnRenamed("line", "raw").withColumn("line", line).where("line <> ''")
    key = F.regexp_extract("line", rules.KEYED, 1)
    rows = rows.withColumn("key", key).withColumn("value", F.when(F.col("key") == "", F.col("line")).otherwise(F.regexp_extract("line", rules.KEYED, 2)))
    key, value = F.col("key"), F.col("value")
    specified = value.rlike(rules.SPECIFICATION) & (key.rlike(rules.ATTRIBUTE_KEY) | ~value.rlike(rules.PRODUCT_CUE))
    found = F.array_distinct(F.regexp_extract_all(value, F.lit(rules.PART_OR_MODEL), F.lit(0)))
    cases = F.regexp_extract_all(value, F.lit(rules.HISTORY_ID_WITHIN), F.lit(0))
    items = F.when(specified, F.array(value)).when(key.rlike(rules.HISTORY_CUE) & (F.size(found) == 0), cases).otherwise(found)
    rows = rows.withColumn("specified", specified).withColumn("items", items).select("*", F.posexplode("items").alias("at", "mention"))
    word, context = F.col("mention"), F.concat_ws(" ", "key", "line")
    kind = (
        F.when(F.col("specified"), "specification_value").when(word.rlike(rules.NON_PRODUCT), "technical_attribute")
        .when(word.rlike(rules.HISTORY_ID) | (key.rlike(rules.HISTORY_CUE) & word.rlike(rules.RECORD_NUMBER)), "history_record_reference")
        .when(word.rlike(rf"^(?:{rules.SPECIFICATION})$") | (key.rlike(rules.ATTRIBUTE_KEY) & word.rlike(rules.SPECIFICATION)), "specification_value")
        .when(key.rlike(rules.ATTRIBUTE_KEY), "technical_attribute").when(context.rlike(rules.PRODUCT_CUE) & ~context.rlike(rules.HISTORY_CUE), "product").otherwise("part_number")
    )
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "place", "at"))
    return rows.select("doc_id", n.alias("n"), "line_no", "raw", "line", "mention", kind.alias("kind"), (F.size("items") == 1).alias("alone"))


def resolve_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, n, entity_type, entity, relation, parent, line_no, spans, eligible): products by lower-case identifier, attributes, history records and mere context.

    The first mention that makes a product decides its relation.  Whether containment
    or enumeration makes a subject depends on the subjects before it, and attributes
    belong to the last subject before them; both are windows over the mentions of a document.
    """
    rows = typed_mentions(logical_lines(docs)).withColumn("low", F.lower("mention")).withColumn("wording", ck.mention_relation(F.col("line")))
    kind, line, wording = F.col("kind"), F.col("line"), F.col("wording")
    attribute, record = kind.isin("specification_value", "technical_attribute"), kind == "history_record_reference"
    inside = ~attribute & ~record & (line.rlike(rules.PRODUCT_CUE) | ((F.col("line_no") <= 2) & ~line.rlike(rules.REFERENCE)))
    makes = inside | (~attribute & ~record & wording.isin(*rules.REFERRED))
    rows = rows.withColumn("inside", inside).withColumn("makes", makes)
    ordered = Window.partitionBy("doc_id").orderBy("n")
    nth = F.when(F.col("makes"), F.row_number().over(Window.partitionBy("doc_id", "low", "makes").orderBy("n")))
    rows = rows.withColumn("nth", nth)
    listed = wording.isin("history_reference", "comparison_reference", "instruction_reference") & F.col("raw").rlike(rules.ENUMERATED) & F.col("alone")
    own = (wording == "unknown") | listed
    could = F.coalesce((F.col("nth") == 1) & F.col("inside") & (own | (wording == "included_component")), F.lit(False))
    before = F.sum(F.col("could").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", own).withColumn("could", could).withColumn("first", F.coalesce(before, F.lit(0)) == 0)
    rows = rows.withColumn("subject", F.col("could") & (F.col("own") | F.col("first")))
    owner = F.last(F.when(F.col("subject"), F.col("low")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("parent", F.when(~F.col("inside"), owner))
    relation = F.when(F.col("subject"), F.when(F.col("first"), "primary_subject").otherwise("secondary_subject")).otherwise(wording)
    made = F.struct("n", "mention", relation.alias("relation"), "parent", "line_no", F.col("subject").alias("eligible"))
    products = rows.where("makes AND (inside OR nth = 1)").groupBy("doc_id", "low").agg(F.min(F.when(F.col("nth") == 1, made)).alias("m"), F.array_sort(F.collect_list(F.struct("n", "line_no"))).alias("s"))
    products = products.select("doc_id", "m.n", F.lit("product").alias("entity_type"), F.col("low").alias("entity"), "m.relation", "m.parent", "m.line_no", F.transform("s", lambda x: x["line_no"]).alias("spans"), "m.eligible")
    rest = rows.where("NOT makes")
    said = F.when(kind == "history_record_reference", "history_record").when(attribute, "technical_attribute").otherwise("unknown")
    tie = F.when(said == "history_record", "history_reference").when(said == "technical_attribute", "technical_attribute").otherwise("administrative_context")
    return products.unionByName(rest.select("doc_id", "n", said.alias("entity_type"), F.col("mention").alias("entity"), tie.alias("relation"), "parent", "line_no", F.array("line_no").alias("spans"), F.lit(False).alias("eligible")))


def owned_evidence(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, entity, relation, owned, attributes, own_section, classifiable) of each product: distinct lines that speak of it or of its attributes."""
    of = entities.where("entity_type = 'technical_attribute' AND parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("entity")).agg(F.collect_set("line_no").alias("held"), F.count("*").alias("attributes"))
    products = entities.where("entity_type = 'product'").join(large(of), ["doc_id", "entity"], "left")
    held = F.coalesce("held", F.array().cast("array<int>"))
    subject = F.col("relation").isin("primary_subject", "secondary_subject")
    owned = F.size(F.when(subject, F.array_union("spans", held)).otherwise(held))
    sections = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rules.SECTION), F.lit(1)).alias("sections"))
    own = F.exists("sections", lambda s: F.regexp_like(s, F.concat(F.lit(r"(?i)\b\Q"), "entity", F.lit(r"\E\b"))))
    return products.join(large(sections), "doc_id").select("doc_id", "entity", "relation", owned.alias("owned"), F.coalesce("attributes", F.lit(0)).alias("attributes"), own.alias("own_section"), (subject & (owned >= 1)).alias("classifiable"))


def qualify(docs: DataFrame, owned: DataFrame) -> DataFrame:
    """(doc_id, role, state, products, mentions, history, comparisons) of docs(doc_id, text, file_name): whether a document speaks of one product, with evidence enough.

    One product needs two attributes, or technical wording with an attribute, containment or the name of a data sheet.
    """
    relation = F.col("relation")
    counts = owned.groupBy("doc_id").agg(
        F.count_if("classifiable").alias("products"), F.count("*").alias("mentions"), F.count_if(relation == "history_reference").alias("history"), F.count_if(relation == "comparison_reference").alias("comparisons"),
        F.count_if(relation.isin(*rules.REFERRED) & (F.col("classifiable") | (relation.isin("comparison_reference", "history_reference") & (F.col("owned") > 0)))).alias("clashes"),
        F.sum(F.when(F.col("classifiable"), F.col("attributes")).otherwise(0)).alias("attributes"),
    )
    text, c = F.coalesce("text", F.lit("")), F.col
    rows = docs.select("doc_id", ck.document_role(text, F.coalesce("file_name", F.lit(""))).alias("role"), text.rlike(rules.TECHNICAL).alias("technical"), text.rlike(rules.CONTAINMENT).alias("contains"), text.rlike(rules.SOURCE_WORDS).alias("sheet")).join(counts, "doc_id", "left")
    rows = rows.fillna(0, ["products", "mentions", "history", "comparisons", "clashes", "attributes"])
    enough = (c("attributes") >= 2) | (c("technical") & ((c("attributes") > 0) | c("contains") | c("sheet")))
    state = (
        F.when(c("clashes") > 0, "entity_reference_coherence_failure").when(c("products") > 1, "multi_entity_requires_segmentation")
        .when(c("products") == 1, F.when(enough, "single_product_classifiable").otherwise("single_product_insufficient_evidence"))
        .when(c("role").isin(*rules.NON_PRODUCT_ROLES), "non_product_context").otherwise("insufficient_product_evidence")
    )
    plain = F.when(state == "multi_entity_requires_segmentation", "multi_product_catalog").when(state == "single_product_classifiable", "single_product_technical_source").when(state == "single_product_insufficient_evidence", "product_intake").otherwise("unknown")
    intake = (state == "single_product_insufficient_evidence") & c("role").isin("test_manifest", "readme")
    role = F.when((c("role") == "unknown") | intake, plain).otherwise(c("role"))
    return rows.select("doc_id", role.alias("role"), state.alias("state"), "products", "mentions", "history", "comparisons")


def route_documents(qualified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that go on to classification, and those that only get an intake report."""
    one = F.col("state") == "single_product_classifiable"
    return qualified.where(one), qualified.where(~one)


def intake_reports(waiting: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, report): the qualification, subjects and attached context of documents that don't go on, as Markdown lines."""
    listed = lambda test, what: F.array_sort(F.collect_list(F.when(test, F.struct("n", what.alias("x")))))
    kind = F.col("entity_type")
    held = entities.join(large(waiting.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(
        listed((kind == "product") & F.col("eligible"), F.concat_ws(" - ", F.upper("entity"), "relation")).alias("subjects"),
        listed(kind.isin("technical_attribute", "history_record"), F.concat(F.when(kind == "history_record", "- Internal history reference: ").otherwise("- Technical attribute: "), "entity")).alias("context"),
    )
    rows = waiting.join(large(held), "doc_id", "left")
    lines = lambda c, f, none: F.coalesce(F.when(F.size(c) > 0, F.transform(F.col(c), f)), F.array(F.lit(none)))
    body = F.concat(
        F.array(F.lit("## Document qualification"), F.concat(F.lit("- Document role: "), "role"), F.concat(F.lit("- Classifiability: "), "state"), F.lit("## Detected product entities")),
        lines("subjects", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["x"]), "- No coherent product entity was detected."), F.array(F.lit("## Attached context")),
        lines("context", lambda s, _: s["x"], "- No entity-scoped technical attributes were retained."),
    )
    return rows.select("doc_id", F.array_join(body, "\n").alias("report"))

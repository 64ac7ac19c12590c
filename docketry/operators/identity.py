"""Who a document is about, and facts that count only by what stands near them.

Each rule is a literal pattern; its matches are told with offsets, their
surroundings are looked at once, and words there keep or drop a match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators.facts import dedupe_facts, memory_integrity
from docketry.operators.ranked_facts import spans
from docketry.rules import identity as rules

FACT = "struct<fact_ord:int,name:string,value:string,unit:string,snippet:string,category:string,confidence:string>"


def _fact(order: int, name: str, value: Column, snippet: Column, category: str, confidence: str | Column) -> Column:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(F.lit(order).alias("fact_ord"), F.lit(name).alias("name"), value.alias("value"), F.lit(None).cast("string").alias("unit"), snippet.alias("snippet"), F.lit(category).alias("category"), sure.alias("confidence")).cast(FACT)


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body, top): the text without carriage returns, and its head."""
    return docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("body")).withColumn("top", F.substring("body", 1, rules.TOP))


def _line(text: Column, m: Column) -> Column:
    """The whole squashed line round a match."""
    before = F.substring_index(F.substring(text, F.lit(1), m["start"]), "\n", -1)
    after = F.substring_index(F.substring(text, m["stop"] + 1, F.length(text)), "\n", 1)
    return tx.squash_ws(F.concat(before, F.substring(text, m["start"] + 1, m["stop"] - m["start"]), after))


def part_number(body: Column, top: Column) -> Column:
    """The span of the part number: the first match of each pattern, the head before the whole text; not in legal lines, no word, no document number."""

    def good(m: Column) -> Column:
        bad = tx.contains_any(F.lower(_line(body, m)), rules.LEGAL_WORDS) | m["name"].rlike("^[A-Za-z]+$") | m["name"].rlike(f"(?i){rules.DOCUMENT_LIKE}")
        return F.when(~bad, m)

    return F.coalesce(*[tx.bound(F.coalesce(tx.first_span(top, p, 1), tx.first_span(body, p, 1)), good) for p in rules.PART_NUMBERS])


def with_identity(docs: DataFrame) -> DataFrame:
    """(doc_id, body, top, family, part): the texts with the span of an overview family and of the part number."""
    rows = bodies(docs)
    overview = F.coalesce(*[tx.first_span(F.col("body"), f"(?i){p}") for p, many, _ in rules.FAMILIES if many])
    rows = rows.withColumn("family", overview)
    return rows.withColumn("part", F.when(F.col("family").isNull(), part_number(F.col("body"), F.col("top"))))


def _identity(body: Column, top: Column, family: Column, part: Column) -> list[Column]:
    """Arrays of identity facts."""
    at = lambda m: tx.line_at(body, m["start"], m["stop"])
    found = [_families(tx.first_span(body, f"(?i){pattern}"), i, facts, body) for i, (pattern, _, facts) in enumerate(rules.FAMILIES)]
    head = F.substring(body, 1, rules.NUMBER_TOP)
    kind = lambda m: F.when(F.lower(m["name"]) == "datasheet", "Data Sheet").when(F.lower(m["name"]) == "overview", "Product Specification").otherwise(m["name"])
    number = F.when(family.isNotNull(), tx.bound(tx.first_span(head, f"(?i){rules.DOCUMENT_NUMBER}", 1), lambda m: _fact(20, "document_number", F.upper(m["name"]), at(m), "product_identity", "high")))
    sort = F.when(family.isNotNull(), tx.bound(tx.first_span(head, f"(?i){rules.DOCUMENT_TYPE}", 1), lambda m: _fact(21, "document_type", kind(m), at(m), "product_identity", "medium")))
    own = tx.bound(part, lambda m: _fact(30, "part_number", m["name"], at(m), "product_identity", "high"))
    devices = [_device(top, body, *device) for device in rules.DEVICE_TYPES]
    lines = F.filter(F.split(top, "\n"), lambda x: x.rlike(f"(?i)(?:{rules.DESCRIBING})"))
    told = F.transform(F.array(tx.squash_ws(F.get(lines, F.lit(0)))), lambda x: F.when(tx.contains_any(F.lower(x), rules.DESCRIPTION_WORDS), _fact(50, "product_description", x, x, "product_identity", "medium")))[0]
    return [*found, F.array(number, sort, own, F.coalesce(*devices), told)]


def _families(span: Column, i: int, facts: tuple, body: Column) -> Column:
    made = lambda m: F.array(*[_fact(10 * i + j, name, F.lit(value), tx.line_at(body, m["start"], m["stop"]), category, "high") for j, (name, value, category) in enumerate(facts)])
    return F.coalesce(tx.bound(span, made), F.array().cast(f"array<{FACT}>"))


def _device(top: Column, body: Column, pattern: str, label: str, sure: str) -> Column:
    return tx.bound(tx.first_span(top, f"(?i){pattern}"), lambda m: _fact(40, "device_type", F.lit(label), tx.line_at(body, m["start"], m["stop"]), "product_identity", sure))


def extract_identity(docs: DataFrame) -> DataFrame:
    """(doc_id, facts' columns): family, part number, document number and type, device type and description of each text.

    An overview of a family has no part number of its own; only such overviews tell document numbers.
    """
    rows = with_identity(docs)
    made = F.concat(*_identity(F.col("body"), F.col("top"), F.col("family"), F.col("part")))
    return rows.select("doc_id", F.inline(F.array_compact(made)))


def _nearby(body: Column, order: int, name: str, value: str, category: str, pattern: str, size: int, need: tuple, bar: tuple, every: bool) -> Column:
    """The facts of one rule: matches with a needed word near them and no barred one."""
    none = F.array().cast("array<struct<start:int,stop:int,name:string>>")
    if every:
        found = F.when(body.rlike(f"(?is){pattern}"), spans(body, pattern)).otherwise(none)
    else:
        found = F.array_compact(F.array(tx.first_span(body, f"(?is){pattern}", 1)))

    def keep(m: Column) -> Column:
        def told(near: Column) -> Column:
            good = F.lit(True)
            if need:
                good &= tx.contains_any(near, need)
            if bar:
                good &= ~tx.contains_any(near, bar)
            shown = F.lit(value) if value else tx.squash_ws(m["name"])
            return F.when(good, _fact(order, name, shown, tx.line_at(body, m["start"], m["stop"]), category, "medium"))

        return F.transform(F.array(tx.context_at(body, m["start"], m["stop"], size)), told)[0]

    return F.transform(found, keep)


def _architecture(body: Column, part: Column) -> Column:
    """The first architecture that isn't another's and whose line names the part or the device."""

    def one(pattern: str, name: str) -> Column:
        def told(m: Column) -> Column:
            line = F.lower(_line(body, m))
            own = tx.contains_any(line, rules.OWN_DEVICE) | F.coalesce(line.contains(F.lower(part["name"])), F.lit(False))
            compared = tx.contains_any(tx.context_at(body, m["start"], m["stop"], rules.CONTEXT), rules.COMPARED)
            return F.when(own & ~compared, _fact(3100, "converter_architecture", F.lit(name), tx.line_at(body, m["start"], m["stop"]), "converter_performance", "medium"))

        return tx.bound(tx.first_span(body, f"(?i){pattern}"), told)

    return F.array(F.coalesce(*[one(p, n) for p, n in rules.ARCHITECTURES]))


def _clock_note(body: Column) -> Column:
    """The first line with a clock and a rate in GHz, if it speaks of clocking outside the device."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("(?i)clock|sysref") & x.rlike(r"(?i)\d+(?:\.\d+)?\s*GHz"))
    return F.transform(F.slice(lines, 1, 1), lambda x: F.when(tx.contains_any(F.lower(tx.squash_ws(x)), rules.EXTERNAL_CLOCK), _fact(3200, "clocking_reference_note", tx.squash_ws(x), tx.squash_ws(x), "digital_interface", "low")))


def context_facts(docs: DataFrame) -> DataFrame:
    """Facts kept by their surroundings: stacked memory, modulation, upsets, elliptic curves, security functions, architecture, clock notes and memory ECC; each (name, value) once."""
    rows = with_identity(docs)
    body, part = F.col("body"), F.col("part")
    nearby = [_nearby(body, 3000 + i, *rule) for i, rule in enumerate(rules.NEARBY)]
    found = rows.select("doc_id", F.inline(F.array_compact(F.concat(*nearby, _architecture(body, part), _clock_note(body)))))
    return dedupe_facts(reduce(DataFrame.unionByName, (found, memory_integrity(docs))))

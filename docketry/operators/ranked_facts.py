"""Facts that are chosen among many mentions: the manufacturer and the interface revision.

All mentions of a text are ranked inside its row, so nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.joins import large
from docketry.operators.facts import SCHEMA
from docketry.rules import facts as rules


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, name>> of all matches of a pattern of one group, 0-based; name is the group, empty if it took no part.

    The parts between the matches and the matches themselves tell the places, so each text is searched in one pass from match to match.
    """
    p = F.lit(f"(?is){pattern}")
    found = F.regexp_extract_all(text, p, F.lit(0))
    parted = F.slice(F.split(text, f"(?is){pattern}", -1), F.lit(1), F.size(found))
    whole = F.arrays_zip(parted.alias("lead"), found.alias("all"), F.regexp_extract_all(text, p, F.lit(1)).alias("name"))
    none = F.array().cast("array<struct<start:int,stop:int,name:string>>")

    def add(made: Column, x: Column) -> Column:
        past = F.coalesce(F.try_element_at(made, F.lit(-1))["stop"], F.lit(0))
        return F.concat(made, F.array(F.struct((past + F.length(x["lead"])).alias("start"), (past + F.length(x["lead"]) + F.length(x["all"])).alias("stop"), F.coalesce(x["name"], F.lit("")).alias("name"))))

    return F.aggregate(whole, none, add)


def whole_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, name>> of all matches of a pattern, 0-based; name is the whole match.

    The parts between the matches and the matches themselves tell the places, so each text is searched in one pass from match to match.
    """
    p = F.lit(f"(?is){pattern}")
    found = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.split(text, f"(?is){pattern}", -1)
    none = F.array().cast("array<struct<start:int,stop:int,name:string>>")

    def add(made: Column, x: Column) -> Column:
        past = F.coalesce(F.try_element_at(made, F.lit(-1))["stop"], F.lit(0))
        return F.concat(made, F.array(F.struct((past + F.length(x["lead"])).alias("start"), (past + F.length(x["lead"]) + F.length(x["all"])).alias("stop"), F.coalesce(x["name"], F.lit("")).alias("name"))))

    def placed(matches: Column) -> Column:
        return F.aggregate(F.arrays_zip(F.slice(parts, F.lit(1), F.size(matches)).alias("lead"), matches.alias("all"), matches.alias("name")), none, add)

    # one element, so that the matches are found once
    return F.transform(F.array(found), placed)[0]


def rank_manufacturer(docs: DataFrame) -> DataFrame:
    """(doc_id, value, snippet, confidence): the mention of least score, the earlier one of equals.

    Mentions begin at 50; a data sheet nearby, a notice and an early place take 35, 10
    and 8 off; boilerplate doesn't count.  The head of the text is tried first, the
    whole only if it is longer and the head names none.
    """
    # the letter that names begin with is looked at first: few places of a text have one
    names = rf"\b(?=[{''.join(sorted({m[0].lower() for m in rules.MANUFACTURERS}))}])(?:" + "|".join(rules.MANUFACTURERS) + r")\b"
    rows = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("body")).withColumn("top", F.substring("body", 1, rules.MAKER_TOP))

    def best(c: str) -> Column:
        def seen(m: Column) -> Column:
            near = tx.context_at(F.col(c), m["start"], m["stop"], rules.MAKER_AROUND)
            return F.struct(m["start"].alias("start"), m["name"].alias("name"), near.alias("near"), tx.line_at(F.col(c), m["start"], m["stop"]).alias("line"))

        def scored(m: Column) -> Column:
            less = F.when(tx.contains_any(m["near"], rules.MAKER_SHEET), 35).otherwise(0) + F.when(tx.contains_any(m["near"], rules.MAKER_NOTICE), 10).otherwise(0) + F.when(m["start"] < rules.MAKER_EARLY, 8).otherwise(0)
            return F.struct((50 - less).alias("score"), m["start"].alias("start"), m["name"].alias("name"), m["line"].alias("line"))

        weak = lambda m: tx.contains_any(F.lower(m["line"]), rules.MAKER_BOILERPLATE) | tx.contains_any(m["near"], rules.MAKER_BOILERPLATE)
        return F.array_min(F.transform(F.filter(F.transform(whole_spans(F.col(c), names), seen), lambda m: ~weak(m)), scored))

    rows = rows.withColumn("low", F.lower("body"))
    found = F.coalesce(best("top"), F.when(F.length("body") > rules.MAKER_TOP, best("body")))
    found = F.when(tx.contains_any(F.col("low"), tuple(name.lower() for name in rules.MANUFACTURERS)), found)
    # a generator, as a filter would be moved below the columns and build the text anew for each of their uses
    rows = rows.select("doc_id", F.explode(F.array_compact(F.array(found))).alias("m"))
    spelled = F.coalesce(F.create_map(*[F.lit(x) for pair in rules.MAKER_SPELLING for x in pair])[F.lower("m.name")], F.col("m.name"))
    return rows.select("doc_id", spelled.alias("value"), F.col("m.line").alias("snippet"), F.when(F.col("m.score") <= rules.MAKER_SURE, "high").otherwise("medium").alias("confidence"))


def rank_interface_revision(docs: DataFrame) -> DataFrame:
    """(doc_id, name, value, snippet, confidence): the main revision of the serial interface, and the other ones that the text calls compatible.

    A revision beside the interface's heading is first, then C before B before A, then the earlier one; a bare mention only counts without any revision.
    """
    rows = docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("body")).withColumn("found", spans(F.col("body"), rules.REVISION)).where(F.size("found") > 0)

    def told(m: Column) -> Column:
        near = tx.context_at(F.col("body"), m["start"], m["stop"], rules.REVISION_AROUND)
        revision = F.upper(m["name"])
        order = F.when(revision == "", 9).otherwise(F.instr(F.lit("CBA"), revision))
        apart = (revision == "") | ~near.contains("serial data interface")
        return F.struct(apart.cast("int").alias("apart"), order.alias("order"), m["start"].alias("start"), F.concat(F.lit("JESD204"), revision).alias("value"), tx.line_at(F.col("body"), m["start"], m["stop"]).alias("line"), tx.contains_any(near, ("compatible", "receiver", "subclass")).alias("noted"))

    rows = rows.withColumn("told", F.transform("found", told)).withColumn("main", F.array_min("told"))
    named = F.filter("told", lambda t: t["order"] < 9)
    rows = rows.withColumn("named", named).withColumn("others", F.array_distinct(F.transform(F.filter("named", lambda t: t["noted"] & (t["value"] != F.col("main.value"))), lambda t: t["value"])))
    note = tx.squash_ws(F.regexp_extract("body", rules.REVISION_NOTE, 0))
    line = F.when(note != "", note).otherwise(F.try_element_at("named", F.lit(-1))["line"])
    main = F.struct(F.lit("jesd_interface").alias("name"), F.col("main.value").alias("value"), F.col("main.line").alias("snippet"), F.lit("high").alias("confidence"))
    other = F.when(F.size("others") > 0, F.struct(F.lit("jesd_other_references").alias("name"), F.array_join("others", " / ").alias("value"), line.alias("snippet"), F.lit("medium").alias("confidence")))
    return rows.select("doc_id", F.inline(F.array_compact(F.array(main, other))))


def profile_facts(facts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Facts with the profile facts anew: profile, confidence, rationale and one a further profile, after all others.  ranked(doc_id, rank, profile, score)."""
    kept = facts.where(~F.col("name").isin(*rules.PROFILE_FACTS))
    first = facts.where("snippet <> ''").groupBy("doc_id").agg(F.min_by("snippet", "fact_ord").alias("snippet"))
    found = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "profile", "score"))).alias("r")).join(large(first), "doc_id", "left")
    score = F.col("r")[0]["score"]
    level = F.when(score >= 14, "high").when(score >= 8, "medium").otherwise("low")
    names = F.transform("r", lambda x: x["profile"])
    made = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    why = F.concat(F.lit("Selected from weighted signals with score "), score.cast("string"), F.lit("; active profiles: "), F.array_join(names, ", "), F.lit("."))
    rows = F.concat(F.array(made("product_profile", names[0]), made("profile_confidence", level), made("profile_rationale", why)), F.transform(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda p: made("secondary_product_profile", p)))
    new = found.select("doc_id", F.coalesce("snippet", F.lit(rules.PROFILE_SNIPPET)).alias("snippet"), level.alias("confidence"), F.posexplode(rows).alias("i", "x"))
    new = new.select("doc_id", (F.lit(100_000) + F.col("i")).alias("fact_ord"), "x.name", "x.value", F.lit(None).cast("string").alias("unit"), "snippet", F.lit("profile_detection").alias("category"), "confidence")
    return kept.select(*SCHEMA).unionByName(new)


def fact_links(candidates: DataFrame, facts: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, code, fact_ord, matched_value): the first fact of each of the first ``most`` names that a candidate cites, each once.  candidates(doc_id, code, matched array)."""
    cited = candidates.select("doc_id", "code", F.explode(F.slice("matched", 1, most)).alias("cited"))
    cited = cited.select("doc_id", "code", F.replace(F.lower(F.trim(F.substring_index("cited", ":", 1))), F.lit(" "), F.lit("_")).alias("name")).distinct()
    first = facts.groupBy("doc_id", "name").agg(F.min(F.struct("fact_ord", "value", "unit")).alias("f"))
    return cited.join(large(first), ["doc_id", "name"]).select("doc_id", "code", F.col("f.fact_ord").alias("fact_ord"), F.concat_ws(" ", "f.value", "f.unit").alias("matched_value"))

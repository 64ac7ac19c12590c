"""Segments, evidence with polarity and scope, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.joins import large
from docketry.rules import wording
from docketry.rules.signals import SIGNALS

#: Sentences and what stands between them; together they tile the text, so offsets are running sums.
PIECES = r"[^.!?\n\r]+[.!?]*|[.!?\n\r]+"
EXCLUDED = ("other_or_family_configuration", "optional_or_future_configuration", "non_export_configuration")


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, end, quote) of each sentence; a line end, and each dot, question or exclamation mark, ends one."""
    pieces = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECES), F.lit(0))).alias("ordinal", "piece"))
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    pieces = pieces.withColumn("quote", tx.squash_ws(F.col("piece"))).where(F.col("quote").rlike(r"[^.!?\n\r]"))
    return pieces.select("doc_id", "ordinal", "start", (F.col("start") + F.length("piece")).alias("end"), "quote")


#: Words in the longest term.
LONGEST_TERM = 4


def _grams(lowered: Column, longest: int) -> Column:
    """Runs of one to ``longest`` words of a lower-case text, with what stands between them."""
    # a blank in front: the first piece is no word, and every second one is
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), lowered), F.lit("[a-z0-9]+|[^a-z0-9]+"), F.lit(0))

    def runs(ps: Column) -> Column:
        widths = F.array(*[F.lit(2 * k + 1) for k in range(longest)])
        starts = F.when(F.size(ps) > 1, F.sequence(F.lit(2), F.size(ps), F.lit(2)))
        return F.flatten(F.transform(starts, lambda i: F.transform(widths, lambda w: F.array_join(F.slice(ps, i, w), ""))))

    return F.transform(F.array(pieces), runs)[0]


def match_terms(sentences: DataFrame, signals: tuple = SIGNALS, longest: int = LONGEST_TERM) -> DataFrame:
    """(doc_id, signal, terms, quote, start, end): one row for each sentence and signal with a term in it.

    A sentence's word runs are looked up in the set of all terms, so its cost grows with its own length and not with
    the rules; only sentences that hold a term are told apart by signal.  Terms begin and end with a letter or digit
    and have ``longest`` words at most.
    """
    every = list(dict.fromkeys(t for _, _, _, terms in signals for t in terms))
    matched = F.array_intersect(_grams(F.lower("quote"), longest), F.lit(every))

    def by_signal(m: Column) -> Column:
        each = F.array(*[F.struct(F.lit(key).alias("signal"), F.array_intersect(F.lit(list(terms)), m).alias("terms")) for key, _, _, terms in signals])
        return F.when(F.size(m) > 0, F.filter(each, lambda x: F.size(x["terms"]) > 0))

    # one element, so that the matches are bound once
    found = F.transform(F.array(matched), by_signal)[0]
    return sentences.select("doc_id", "start", "end", "quote", F.inline(found)).select("doc_id", "signal", "terms", "quote", "start", "end")


def with_polarity(evidence: DataFrame) -> DataFrame:
    """Adds polarity, scope, confidence and a stable id."""
    polarity = tx.polarity(F.col("quote"))
    return evidence.withColumn("polarity", polarity).withColumn("scope", tx.config_scope(F.col("quote"))).withColumn(
        "confidence", F.when(F.col("polarity").isin("present", "absent"), 0.98).otherwise(0.65)
    ).withColumn("evidence_id", tx.stable_id("ev_", F.col("signal"), F.col("quote"), F.col("start").cast("string")))


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """The first row of each (document, signal, lower-case quote, polarity, scope)."""
    same = Window.partitionBy("doc_id", "signal", F.lower("quote"), "polarity", "scope").orderBy("start")
    return evidence.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")


def source_evidence(docs: DataFrame) -> DataFrame:
    """Evidence of the source sentences of docs(doc_id, text)."""
    return dedupe_evidence(with_polarity(match_terms(segments(docs))))


def effective_polarity(evidence: DataFrame) -> DataFrame:
    """(doc_id, signal, effective): that of the current configuration, else of no excluded scope, else of all rows."""
    tiers = {"current": F.col("scope") == "current_configuration", "plain": ~F.coalesce(F.col("scope").isin(*EXCLUDED), F.lit(False)), "every": F.lit(True)}
    kinds = ("present", "absent", "ambiguous")
    had = evidence.groupBy("doc_id", "signal").agg(
        *[F.coalesce(F.bool_or(test), F.lit(False)).alias(t) for t, test in tiers.items()],
        *[F.coalesce(F.bool_or(test & (F.col("polarity") == k)), F.lit(False)).alias(f"{t}_{k}") for t, test in tiers.items() for k in kinds],
    )

    def of(t: str) -> Column:
        present, absent, ambiguous = (F.col(f"{t}_{k}") for k in kinds)
        return F.when(present & absent, "ambiguous").when(absent, "absent").when(present, "present").when(ambiguous, "ambiguous").otherwise("unknown")

    return had.select("doc_id", "signal", F.when(F.col("current"), of("current")).when(F.col("plain"), of("plain")).otherwise(of("every")).alias("effective"))


def contradictory_pairs(evidence: DataFrame) -> DataFrame:
    """Each present with each absent row of a signal: blocking unless both name a scope and the scopes differ."""
    left = evidence.where("polarity = 'present'").select("doc_id", "signal", F.col("evidence_id").alias("evidence_a"), F.col("scope").alias("scope_a"))
    right = evidence.where("polarity = 'absent'").select("doc_id", "signal", F.col("evidence_id").alias("evidence_b"), F.col("scope").alias("scope_b"))
    pairs = left.join(large(right), ["doc_id", "signal"])
    by_scope = F.col("scope_a").isNotNull() & F.col("scope_b").isNotNull() & (F.col("scope_a") != F.col("scope_b"))
    return pairs.select(
        "doc_id", "signal", "evidence_a", "evidence_b", F.when(by_scope, "configuration_conflict").otherwise("explicit_positive_vs_negative").alias("kind"),
        F.when(by_scope, "major").otherwise("blocking").alias("severity"), F.when(by_scope, "resolved_by_scope").otherwise("unresolved").alias("resolution"),
    )


def untrusted(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of each instruction pattern in a document."""
    return docs.select("doc_id", F.explode(tx.untrusted_instructions(F.col("text"))).alias("pattern"))


def affirmed_crypto(docs: DataFrame) -> DataFrame:
    """(doc_id, supported, terms): whether an affirmed line names a candidate-grade term, and which terms."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lowered = F.lower("line")
    terms = F.array_compact(F.array(*[F.when(tx.term_found(lowered, t), F.lit(t)) for t in wording.CRYPTO_TERMS]))
    found = lines.withColumn("terms", terms).where((F.size("terms") > 0) & (tx.line_polarity(F.col("line")) == "affirmed"))
    found = found.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return docs.select("doc_id").join(large(found), "doc_id", "left").select("doc_id", F.col("terms").isNotNull().alias("supported"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))

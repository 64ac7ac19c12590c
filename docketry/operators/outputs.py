"""Checks on finished runs: whether each claim of a run is grounded in its source, and what its memo and facts must not hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.operators.facts import display_name
from docketry.operators.nested import each, nest
from docketry.rules import outputs as rules

ISSUE = "array<struct<code:string,place:bigint,detail:string>>"


def normal(c: Column) -> Column:
    return F.lower(tx.squash_ws(F.coalesce(c, F.lit(""))))


def _issue(code: str, place: Column, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), place.cast("bigint").alias("place"), detail.alias("detail"))


def _memo(code: str, *found: tuple[Column, str | Column]) -> Column:
    """One issue for each condition that holds."""
    nowhere = F.lit(None).cast("bigint")
    return F.array_compact(F.array(*[F.when(holds, _issue(code, nowhere, F.lit(d) if isinstance(d, str) else d)) for holds, d in found]))


def told(name: Column, value: Column, unit: Column) -> Column:
    """A fact as memos tell it: its label, value and unit."""
    return F.concat(display_name(name), F.lit(": "), F.coalesce(value, F.lit("")), F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(""))


def _family(name: Column, value: Column) -> Column:
    low = F.lower(value)
    named = F.coalesce(*[F.when((name == n) | (low == f), F.lit(f)) for n, f in rules.INTERFACES if f != "displayport"])
    shown = name.isin(*[n for n, f in rules.INTERFACES if f == "displayport"]) | low.contains("displayport")
    return F.coalesce(named, F.when(shown, F.lit("displayport")), low)


def _any(c: Column, terms: Iterable[str]) -> Column:
    return tx.contains_any(c, tuple(terms))


def _boilerplate(c: Column) -> Column:
    return _any(c, rules.BOILERPLATE_PHRASES) | c.rlike(r"\b(?:" + "|".join(rules.BOILERPLATE_WORDS) + r")\b")


def described(facts: DataFrame) -> DataFrame:
    """facts with what the checks compare, worked out once a fact: told, shown and family."""
    return facts.withColumns({"told": normal(told(F.col("name"), F.col("value"), F.col("unit"))), "shown": normal(F.col("snippet")), "family": _family(F.col("name"), F.coalesce("value", F.lit("")))})


def _malformed(markdown: Column) -> Column:
    """Why the Markdown is malformed, or null."""
    fences = (F.length(markdown) - F.length(F.replace(markdown, F.lit("```"), F.lit("")))) / 3 % 2 == 1
    fourth, third = F.regexp_instr(markdown, F.lit("(?m)^#### ")), F.regexp_instr(markdown, F.lit("(?m)^### "))
    early = (fourth > 0) & ((third == 0) | (third > fourth))

    def ordered(sections: tuple[str, ...]) -> Column:
        at = F.array(*[F.instr(markdown, s) for s in sections])
        return ~F.exists(at, lambda x: x == 0) & (F.array_sort(at) == at)

    unordered = ~(ordered(rules.SECTIONS[0]) | ordered(rules.SECTIONS[1]))
    return F.when(fences, "unbalanced fenced code block").when(early, "fourth-level heading appears before third-level heading").when(unordered, "required memo sections are missing or out of order")


def _memo_checks(stale: tuple) -> list[Column]:
    markdown, memo, text, facts = F.col("markdown"), F.col("memo"), F.col("source"), F.col("facts")
    secure = F.exists(facts, lambda f: f["name"].isin(*rules.SECURITY_NAMES) | (f["category"] == rules.SECURITY_CATEGORY))
    low = F.lower(markdown)
    at = F.instr(low, rules.CONCLUSION)
    conclusion = F.when(at > 0, F.substring(low, at, F.length(low))).otherwise(low)
    device = F.coalesce(
        *[F.when(F.upper("title").contains(d), F.lit(d)) for d, _ in stale],
        F.get(each(facts, lambda f: F.when((f["name"] == "part_number") & F.upper(f["value"]).isin(*[d for d, _ in stale]), F.upper(f["value"]))), F.lit(0)),
    )
    malformed = _malformed(markdown)
    return [
        _memo("FEW_FACTS", (F.size(facts) < rules.LEAST_FACTS, F.size(facts).cast("string"))),
        _memo("TEMPLATE_MARKER", *[(markdown.rlike(f"(?i){p}"), p) for p in rules.TEMPLATES]),
        _memo("WEAK_REASON", *[(memo.contains(f"why it matters: {w}"), w) for w in rules.WEAK_REASONS]),
        _memo("RAW_JSON_MEMO", (F.ltrim(markdown, F.lit(" \t\n\r")).startswith("{"), F.substring(markdown, 1, 20))),
        _memo("FINAL_DETERMINATION", *[(memo.rlike(p), p) for p in rules.FINAL]),
        _memo("MALFORMED_MEMO", (malformed.isNotNull(), malformed)),
        _memo("SECURITY_PATH_UNNAMED", (secure & ~conclusion.contains(rules.SECURITY_PATH), rules.SECURITY_PATH)),
        _memo("STALE_MARKER", *[((device == d) & memo.contains(m.lower()) & ~text.contains(m.lower()), m) for d, markers in stale for m in markers]),
        _memo("RADIATION_UNSUPPORTED", (markdown.rlike(r"\bSEL\b") & ~_any(memo, rules.RADIATION_CONTEXT), "SEL")),
        _memo("CHANNEL_WORDING", (markdown.contains("1 channels"), "1 channels")),
    ]


def _fact_checks() -> list[Column]:
    facts = F.col("facts")
    families = each(facts, lambda f: F.when(f["name"].isin(*[n for n, _ in rules.INTERFACES]), f["family"]))

    def check(code: str, holds, detail=lambda f: f["snippet"]) -> Column:
        return each(facts, lambda f: F.when(holds(f), _issue(code, f["fact_ord"], detail(f))))

    name, value = (lambda f: f["name"]), (lambda f: f["value"])
    return [
        check("GENERIC_INTERFACE", lambda f: (f["name"] == "digital_interface") & F.array_contains(families, f["family"]), value),
        check("SNIPPET_MISSING", lambda f: F.coalesce(f["snippet"], F.lit("")) == "", name),
        check("REASON_MISSING", lambda f: F.coalesce(f["importance"], F.lit("")) == "", name),
        check("BOILERPLATE_MANUFACTURER", lambda f: (f["name"] == "manufacturer") & _boilerplate(f["shown"])),
        check("LEGAL_PART_NUMBER", lambda f: (f["name"] == "part_number") & normal(f["value"]).isin(*rules.LEGAL_PARTS), value),
        check("RESOLUTION_OUT_OF_CONTEXT", lambda f: (f["name"] == "adc_resolution") & _any(f["shown"], rules.RESOLUTION_CONTEXT)),
        check("CHANNEL_MODE_OUT_OF_CONTEXT", lambda f: (f["name"] == "channel_modes") & _any(f["shown"], rules.CHANNEL_CONTEXT)),
        check("MEMORY_ECC_AS_CRYPTO", lambda f: (f["name"] == "cryptographic_algorithm") & (F.upper(f["value"]) == "ECC") & _any(f["shown"], rules.MEMORY_CONTEXT)),
        check("PWM_AS_MODULATION", lambda f: (f["name"] == "modulation_feature") & (normal(f["value"]).contains("pwm") | f["shown"].contains("pwm"))),
        check("PICOSECONDS_AS_SYSTEM", lambda f: f["name"].isin("processing_system", "ps_pl_integration") & f["shown"].rlike(r"\bps\b") & f["shown"].contains("picosecond")),
        check("FORMULA_AS_PERFORMANCE", lambda f: (f["name"] == "enob") & _any(f["shown"], rules.FORMULA_CONTEXT)),
    ]


def question_tokens(question: Column) -> Column:
    """The interface and numeric tokens of a question, in lower case."""
    found = F.concat(*[F.regexp_extract_all(question, F.lit(f"(?i){p}"), F.lit(0)) for p in rules.QUESTION_TOKENS])
    return F.transform(found, normal)


def _claim_checks() -> list[Column]:
    """Groundedness of what candidates claim, cite and ask, against the run's own text and facts."""
    facts, candidates, text = F.col("facts"), F.col("candidates"), F.col("source")
    tells, shows = F.transform(facts, lambda f: f["told"]), F.transform(facts, lambda f: f["shown"])

    def claims(code: str, part: str, bad) -> Column:
        return F.flatten(F.transform(candidates, lambda c: each(c[part], lambda x: F.when(bad(x), _issue(code, c["cand_ord"], x)))))

    def identities(c: Column) -> Column:
        return F.size(F.filter(c["claims"], lambda x: F.lower(x).rlike("^(?:" + "|".join(rules.IDENTITY_LABELS) + ")")))

    asked = F.flatten(F.transform(candidates, lambda c: c["questions"]))
    often = F.filter(F.array_distinct(asked), lambda q: F.size(F.filter(asked, lambda x: x == q)) > rules.MOST_REPEATS)
    nowhere = F.lit(None).cast("bigint")
    tokens = F.flatten(F.transform(candidates, lambda c: F.transform(F.flatten(F.transform(c["questions"], question_tokens)), lambda t: F.struct(c["cand_ord"].alias("place"), t.alias("token")))))
    return [
        F.transform(often, lambda q: _issue("QUESTION_REPEATED", nowhere, q)),
        each(candidates, lambda c: F.when((identities(c) * 2 > F.size(c["claims"])) & (F.size(c["claims"]) >= rules.LEAST_CLAIMS), _issue("IDENTITY_DOMINATED", c["cand_ord"], F.array_join(F.slice(c["claims"], 1, 4), ", ")))),
        claims("FACT_UNGROUNDED", "claims", lambda x: ~_any(F.lower(x), rules.UNCLAIMED) & ~F.array_contains(tells, normal(x))),
        claims("CITATION_UNGROUNDED", "cited", lambda x: ~text.contains(normal(x)) & ~F.array_contains(shows, normal(x))),
        each(tokens, lambda t: F.when(~text.contains(t["token"]) & ~F.exists(tells, lambda f: f.contains(t["token"])), _issue("QUESTION_UNGROUNDED", t["place"], t["token"]))),
    ]


def output_checks(runs: DataFrame, facts: DataFrame, candidates: DataFrame, stale: tuple = rules.STALE_MARKERS) -> DataFrame:
    """(run_id, code, place, detail): every issue of every run; place is the fact's or the candidate's ordinal, null for the memo.

    runs(run_id, title, text, markdown), facts(run_id, fact_ord, name, value, unit, snippet, importance, category),
    candidates(run_id, cand_ord, claims, cited, questions), where cited holds the texts of source citations.  A run's
    source is normalised once and travels once, and all of its claims are held against it in its own row.
    """
    parent = runs.select("run_id", "title", F.coalesce("markdown", F.lit("")).alias("markdown"), normal(F.col("markdown")).alias("memo"), normal(F.col("text")).alias("source"))
    shown = described(facts).select("run_id", "fact_ord", "name", "value", "snippet", "importance", "category", "told", "shown", "family")
    rows = nest("run_id", parent, facts=shown, candidates=candidates.select("run_id", "cand_ord", "claims", "cited", "questions"))
    found = F.concat(*[c.cast(ISSUE) for c in (*_memo_checks(stale), *_fact_checks(), *_claim_checks())])
    return rows.select("run_id", F.inline(found))

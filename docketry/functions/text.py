"""Text scalars: columns in, columns out, built-in functions only."""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.rules import wording

WHITE = r"[ \t\n\x0B\f\r]+"


def squash_ws(c: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def preview(c: Column, n: int = 500) -> Column:
    """The first n characters of the squashed text."""
    return F.substring(squash_ws(c), 1, n)


def line_at(text: Column, start: Column, end: Column) -> Column:
    """The line round a match (0-based, end after); 70 characters to each side of the match if it has over 220."""
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    after = F.substring_index(F.substring(text, end + 1, F.length(text)), "\n", 1)
    match = F.substring(text, start + 1, end - start)
    line = squash_ws(F.concat(before, match, after))
    return F.when(F.length(line) <= 220, line).otherwise(context(text, start, end, 70, 70))


def bound(found: Column, make) -> Column:
    """make(value) where the value isn't null; the value is evaluated once."""
    return F.transform(F.array(found), lambda m: F.when(m.isNotNull(), make(m)))[0]


def first_span(text: Column, pattern: str, group: int = 0) -> Column:
    """struct<start, stop, name> of the first match, 0-based; null without one.  name is the group, or the whole match."""
    start = F.regexp_instr(text, F.lit(pattern)) - 1
    made = F.transform(F.array(start), lambda s: F.when(s >= 0, F.struct(s.alias("start"), (s + F.length(F.regexp_extract(text, pattern, 0))).alias("stop"), F.regexp_extract(text, pattern, group).alias("name"))))
    return made[0]


def context(text: Column, start: Column, end: Column, left: int, right: int) -> Column:
    """The squashed window of ``left`` and ``right`` characters round a match."""
    first = F.greatest(start - left, F.lit(0))
    return squash_ws(F.substring(text, first + 1, F.least(end + right, F.length(text)) - first))


def context_at(text: Column, start: Column, end: Column, size: int) -> Column:
    return F.lower(context(text, start, end, size, size))


def excerpt_at(text: Column, start: Column, end: Column) -> Column:
    return context(text, start, end, 120, 180)


def is_specific_code(c: Column) -> Column:
    """Whether the whole value is a control code, as 3A001 or 5A992.c."""
    return F.coalesce(c.rlike(r"^[0-9][A-Z][0-9]{3}(?:\.[A-Za-z0-9]+|[A-Za-z0-9]*)?$"), F.lit(False))


def find_codes(c: Column) -> Column:
    """All distinct control codes of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(wording.CODE), F.lit(0))))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 20 hexadecimal digits of the SHA-256 of the parts joined by 0x1F."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 20))


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [c.contains(t) for t in terms])


def needles(pattern: str) -> tuple[str, ...]:
    """Words of which each match of the pattern, without regard to case, holds one at least; none if the pattern tells none."""

    def of(items) -> set[str] | None:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            found.append({run} if run else None)
            run = ""
            if op is sre.SUBPATTERN:
                found.append(of(arg[-1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[-1]))
            elif op is sre.BRANCH:
                ways = [of(way) for way in arg[1]]
                found.append(set().union(*ways) if all(ways) else None)
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=None)

    words = of(parser.parse(pattern))
    return tuple(sorted(words)) if words and all(w.isascii() for w in words) else ()


def first_found(text: Column, low: Column, pattern: str) -> Column:
    """struct<start, stop> of the first match without regard to case, 0-based; null without one.  low is the text in lower case: a search for words is far cheaper than one by pattern, and most texts hold none of them."""
    start = F.regexp_instr(text, F.lit(f"(?i){pattern}")) - 1
    span = F.transform(F.array(start), lambda s: F.when(s >= 0, F.struct(s.alias("start"), (s + F.length(F.regexp_extract(text, f"(?i){pattern}", 0))).alias("stop"))))[0]
    words = needles(pattern)
    return F.when(contains_any(low, words), span) if words else span


def bounded(terms: tuple[str, ...]) -> str:
    """A pattern for any of the terms with no letter or digit on either side."""
    return "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in terms) + ")(?![a-z0-9])"


def term_found(c: Column, term: str) -> Column:
    """Short words need word borders, longer terms may stand anywhere."""
    return c.rlike(rf"\b{re.escape(term)}\b") if len(term) <= 4 and term.isalnum() else c.contains(term)


def polarity(quote: Column) -> Column:
    """unknown, absent, ambiguous or present: the first class whose wording occurs."""
    q = F.lower(squash_ws(quote))
    return (
        F.when(q.rlike(any_of(wording.UNKNOWN)), "unknown").when(q.rlike(any_of(wording.NEGATION)), "absent")
        .when(q.rlike(any_of(wording.CONDITIONAL)), "ambiguous").otherwise("present")
    )


def config_scope(quote: Column) -> Column:
    """Which configuration a sentence speaks of; null if none is named."""
    q = F.lower(squash_ws(quote))
    return F.coalesce(*[F.when(q.rlike(pattern), F.lit(scope)) for scope, pattern in wording.SCOPES])


def line_polarity(line: Column) -> Column:
    """historical_context, question, missing_evidence, negated, conditional or affirmed, in this order."""
    q = F.lower(squash_ws(line))
    return (
        F.when(contains_any(q, wording.HISTORICAL_MARKS), "historical_context").when(contains_any(q, wording.QUESTION_MARKS), "question")
        .when(contains_any(q, wording.MISSING_MARKS), "missing_evidence").when(q.rlike(wording.NEGATED_CRYPTO), "negated")
        .when(contains_any(q, wording.CONDITIONAL_MARKS), "conditional").otherwise("affirmed")
    )


def untrusted_instructions(text: Column) -> Column:
    """The instruction patterns that occur in a text."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(p)) for p in wording.INSTRUCTIONS]))

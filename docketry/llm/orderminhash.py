"""Document fingerprints by Order MinHash, in DataFrame functions only.

A k-mer is ``K`` neighbouring words (the last ones run over the end, which is a
mark of its own), numbered by its occurrence in the text.  Numbered k-mers are
hashed onto a circle.  Sketch i takes the ``TUPLE`` first of them after the
point i / SKETCHES of the circle, which is a min-wise choice under an order of
its own, puts them back into text order and hashes the tuple.  Two texts agree
in a sketch only if they share its k-mers and have them in the same order, so
the share of equal sketches falls with the edit distance, not only with the
set likeness.

Words rather than characters are the letters of the k-mers: occurrence numbers
need each k-mer of a text sorted and numbered, about one microsecond a k-mer in
these functions, and a text has six times as many characters as words.

Cases: null text is empty; an empty text has one k-mer, the end mark, so two
empty texts are alike.  Equal texts have equal fingerprints.  With one document
the next document is itself.  A null doc_id comes before all others; rows that
repeat a doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCHES = 64
TUPLE = 2
PLACE_BITS = 24
ROWS_PER_BUCKET = 1024
MOST_BUCKETS = 4096

_PLACE = (1 << PLACE_BITS) - 1
_WHITE = " \t\n\x0b\f\r"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use names it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _packed(bits: Column, place: Column) -> Column:
    """The top bits of a hash over a place of PLACE_BITS; never negative."""
    return F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)


def _kmers(words: Column) -> Column:
    """One number for each k-mer: its hash above its place in the text."""
    return F.transform(
        words, lambda w, i: _packed(F.xxhash64(w, F.coalesce(F.get(words, i + 1), F.lit("\n"))), F.least(i, F.lit(_PLACE - 1)).cast("long"))
    )


def _numbered(kmers: Column) -> Column:
    """kmers sorted -> the same places under the hash of (k-mer, occurrence)."""
    top = lambda x: F.shiftright(x, PLACE_BITS)
    starts = F.filter(F.transform(kmers, lambda x, i: F.when((i == 0) | (top(x) != top(F.get(kmers, i - 1))), i)), F.isnotnull)
    return _let(
        starts,
        lambda at: F.flatten(
            F.transform(
                at,
                lambda s, j: F.transform(
                    F.slice(kmers, s + 1, F.coalesce(F.get(at, j + 1), F.size(kmers)) - s),
                    lambda x, o: _packed(F.xxhash64(top(x), o), x.bitwiseAND(F.lit(_PLACE))),
                ),
            )
        ),
    )


def sketches(text: Column, sketches: int = SKETCHES, size: int = TUPLE) -> Column:
    """array<int> of ``sketches`` tuple hashes of a text."""
    words = F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(_WHITE)), f"[{_WHITE}]+")
    points = F.array(*[F.lit(((i << 63) // sketches) | _PLACE) for i in range(sketches)])

    def chosen(circle: Column) -> Column:
        own = F.filter(circle, lambda x: x.bitwiseAND(F.lit(_PLACE)) != _PLACE)
        marks = F.filter(F.transform(circle, lambda x, i: F.when(x.bitwiseAND(F.lit(_PLACE)) == _PLACE, i)), F.isnotnull)

        def tuples(round_: Column) -> Column:
            # k-mers before mark i number its place less i
            return F.transform(
                marks,
                lambda p, i: F.hash(
                    F.transform(
                        F.array_sort(
                            F.transform(
                                F.slice(round_, p - i + 1, size),
                                lambda x: F.struct(x.bitwiseAND(F.lit(_PLACE)).alias("at"), F.shiftright(x, PLACE_BITS).alias("of")),
                            )
                        ),
                        lambda x: x["of"],
                    )
                ),
            )

        # the circle closes: its first k-mers follow its last; a short text gives what it has
        return _let(own, lambda r: _let(F.concat(r, F.slice(r, 1, size)), lambda c: _let(c, tuples)))

    return _let(
        words,
        lambda w: _let(F.sort_array(_kmers(w)), lambda k: _let(F.sort_array(F.concat(_numbered(k), points)), chosen)),
    )


def as_text(sketch: Column) -> Column:
    """Eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long") + 2147483648), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def _bounds(docs: DataFrame, rows: int, most: int) -> tuple[int | None, list[int]]:
    """The least order key, and at most ``most`` keys that part the rest into like ranges."""
    n = docs.count()
    buckets = max(1, min(most, n // rows))
    shares = [i / buckets for i in range(1, buckets)] or [1.0]
    least, at = docs.agg(F.min("at"), F.percentile_approx("at", shares, 10 * most)).first()
    return least, sorted({x for x in at or [] if x > least}) if buckets > 1 else []


def with_next(docs: DataFrame, carry: list[str], rows: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS) -> DataFrame:
    """docs(doc_id, *carry) with next_<c> for each carried column: that of the following doc_id; after the last, of the first.

    Rows go to range buckets whose bounds are keys that occur.  The row at a
    bound is also sent, as an end mark, to the bucket before, so each bucket is
    ordered on its own and no task orders the whole table.
    """
    docs = docs.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    least, bounds = _bounds(docs, rows, most)
    cuts = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    own = F.size(F.filter(cuts, lambda b: b <= F.col("at")))
    before = F.when(F.col("at") == F.lit(least), F.lit(len(bounds))).when(F.array_contains(cuts, F.col("at")), own - 1)
    placed = docs.withColumn("places", F.array_compact(F.array(F.struct(F.lit(0).alias("end"), own.alias("bucket")), F.when(before.isNotNull(), F.struct(F.lit(1).alias("end"), before.alias("bucket"))))))
    placed = placed.select("*", F.inline("places")).drop("places")
    order = Window.partitionBy("bucket").orderBy("end", "at", *carry)
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where("end = 0").drop("at", "bucket", "end")


def fingerprints(docs: DataFrame, k: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """Fingerprint, edited text's fingerprint and likenesses of each row of docs(doc_id, text)."""
    own = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(own.withColumn("sketch", sketches(F.col("text"), k, size)), ["text", "sketch"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = own.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    )
    edited = edited.withColumn("edited_sketch", sketches(F.col("edited"), k, size))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

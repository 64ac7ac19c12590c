"""Language ID by interpolated Kneser-Ney character models.

One model of order ``ORDER`` a language is learned from a sample of training
rows of about ``SAMPLE_CHARS`` characters a language (the documented bound of
what is learned from; a tenth of it calibrates).  The n-grams of all languages
share sorted arrays of 64-bit hashes, with one column of log probabilities a
language, so a character costs one search where any language knows its n-gram
and one more search pair for each order that has to be backed off.

Texts are read as lower-case letters; each run of other characters is one
space.  The language with the lowest cross-entropy per character is chosen.
``score`` is the calibrated probability of the choice: a softmax of the
cross-entropies times the square root of the length, with a factor fitted on the
calibration rows; ``rejected`` marks texts whose cross-entropy is above what
all but ``REJECT`` of the calibration rows of that language have.

Cases: a null text or one without letters is ``und`` with score 0.  Without
training rows all texts are ``und``.  Null langs don't train.  Rows that repeat
a doc_id are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Lookup, U, cuts, utf8
from .tables import remainder

ORDER = 5
SAMPLE_CHARS = 1_500_000
REJECT = 0.001
_SPACE = 32
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], U)
_letters: list[np.ndarray] = []


def _letter(code: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][code]


def characters(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, row of each place): rows of letters and single spaces, each after order-1 spaces."""
    data, offsets = utf8(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    ends = heads[offsets]
    letter = _letter(codes)
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    starts = ends[:-1][ends[:-1] < ends[1:]]
    after[starts] = False
    kept = np.flatnonzero(letter | after)
    row = np.searchsorted(ends[1:], kept, "right")
    places = np.arange(len(kept)) + (row + 1) * (order - 1)
    out = np.full(len(kept) + len(texts) * (order - 1), _SPACE, np.uint32)
    out[places] = np.where(letter[kept], codes[kept], _SPACE)
    return out, places, row


def hashes(codes: np.ndarray, places: np.ndarray, order: int) -> list[np.ndarray]:
    """The hash of the last 1 .. order characters at each place."""
    found, total = [], np.zeros(len(places), U)
    for k in range(order):
        total = total + (codes[places - k].astype(U) + U(1)) * _STEPS[k]
        found.append(total)
    return found


class KneserNey:
    """grams[o]: sorted hashes of the (o+1)-grams and their log probabilities, one column a language; contexts[o]: of
    the histories of o characters and the log of the weight they leave to the next lower order."""

    def __init__(self, codes: np.ndarray, language: np.ndarray, count: np.ndarray, languages: list[str], order: int = ORDER):
        self.languages, self.order = languages, order
        many, last = len(languages), codes.shape[1] - 1
        self.grams, self.contexts = [], []
        suffix = hashes(codes.ravel(), np.arange(len(codes)) * codes.shape[1] + last, order)
        history = [np.zeros(len(codes), U), *hashes(codes.ravel(), np.arange(len(codes)) * codes.shape[1] + last - 1, order - 1)]
        below = None
        for o in range(order):
            keys, first, at = np.unique(suffix[o], return_index=True, return_inverse=True)
            c = np.zeros((len(keys), many))
            if o == order - 1:
                np.add.at(c, (at, language), count)
            else:  # of how many longer n-grams it is the end
                pairs = np.unique(np.stack([suffix[o + 1], language.astype(U)], 1), axis=0, return_index=True)[1]
                np.add.at(c, (at[pairs], language[pairs]), 1)
            context, of = np.unique(history[o][first], return_inverse=True)
            total, kinds = np.zeros((len(context), many)), np.zeros((len(context), many))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
            discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if o == 0:
                lower = np.full((len(keys), many), 1 / (len(keys) + 1))
                self.floor = np.log(weight[0] / (len(keys) + 1))
            else:
                where, _ = self.grams[-1][0].find(suffix[o - 1][first])
                lower = below[where]
            p = np.maximum(c - discount, 0) / np.maximum(total[of], 1) + weight[of] * lower
            self.grams.append((Lookup(keys, c.sum(axis=1)), np.log(p).astype(np.float32)))
            self.contexts.append((Lookup(context, total.sum(axis=1)), np.log(weight).astype(np.float32)))
            below = p

    def logs(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place, one column a language."""
        out = np.zeros((len(places), len(self.languages)), np.float32)
        suffix = hashes(codes, places, self.order)
        left = np.arange(len(places))
        for o in range(self.order - 1, -1, -1):
            at, hit = self.grams[o][0].find(suffix[o][left])
            out[left[hit]] += self.grams[o][1][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if o:
                at, hit = self.contexts[o][0].find(hashes(codes, places[left] - 1, o)[-1])
                out[left[hit]] += self.contexts[o][1][at[hit]]
            else:
                out[left] += self.floor
        return out

    def entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each row under each language, characters of each row)."""
        codes, places, row = characters(texts, self.order)
        logs = self.logs(codes, places)
        n = np.bincount(row, minlength=len(texts))
        total = np.stack([np.bincount(row, logs[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        return -total / np.maximum(n, 1)[:, None], n


def _probability(entropy: np.ndarray, n: np.ndarray, factor: float) -> np.ndarray:
    x = -entropy * np.sqrt(n)[:, None] * factor
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _sample(labelled: DataFrame, chars: int) -> DataFrame:
    """Whole rows (lang, text, held) of about ``chars`` characters a language, picked by the hash of the text."""
    totals = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("total")).where("total > 0").collect()
    if not totals:
        return labelled.limit(0).select("lang", "text", F.lit(0).alias("held"))
    rates = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, chars / r["total"]))])
    draw = F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_003))
    return labelled.where(draw < rates[F.col("lang")] * 1_000_003).select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(10)) == 0).cast("int").alias("held"))


def learned(labelled: DataFrame, chars: int = SAMPLE_CHARS, order: int = ORDER) -> tuple[KneserNey | None, float, np.ndarray | None]:
    """(model, softmax factor, rejection limits) from labelled(lang, text)."""
    rows = _sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), chars)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lang = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
            _, offsets = utf8(texts)
            for i, j in cuts(offsets):
                codes, places, row = characters(pc.utf8_lower(texts.slice(i, j - i)), order)
                if not len(places):
                    continue
                names, of = np.unique(lang[i:j].astype(str), return_inverse=True)
                windows = np.stack([codes[places - k] for k in range(order - 1, -1, -1)] + [of[row].astype(np.uint32)], axis=1)
                kinds, count = np.unique(np.ascontiguousarray(windows).view([("", np.uint32)] * (order + 1)).ravel(), return_counts=True)
                kinds = kinds.view(np.uint32).reshape(-1, order + 1)
                text = np.ascontiguousarray(kinds[:, :order]).tobytes().decode("utf-32-le")
                strings = [text[k : k + order] for k in range(0, len(text), order)]
                yield pa.RecordBatch.from_arrays([pa.array(names[kinds[:, order]].tolist()), pa.array(strings), pa.array(count)], ["lang", "gram", "n"])

    counts = rows.where("held = 0").select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not len(counts):
        return None, 1.0, None
    languages = sorted(set(counts.column("lang").to_pylist()))
    language = np.array([languages.index(x) for x in counts.column("lang").to_pylist()])
    codes = np.frombuffer("".join(counts.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order)
    model = KneserNey(codes, language, counts.column("n").to_numpy(), languages, order)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                entropy, n = shared.value.entropy(pc.utf8_lower(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(n)], ["lang", "entropy", "n"])

    held = [r for r in rows.where("held = 1").select("lang", "text").mapInArrow(measured, "lang string, entropy array<double>, n long").collect() if r["n"] and r["lang"] in languages]
    if not held:
        return model, 1.0, np.full(len(languages), np.inf)
    entropy, n = np.array([r["entropy"] for r in held]), np.array([r["n"] for r in held])
    truth = np.array([languages.index(r["lang"]) for r in held])
    factors = np.geomspace(0.05, 50, 61)
    loss = [-np.log(np.maximum(_probability(entropy, n, f)[np.arange(len(truth)), truth], 1e-12)).mean() for f in factors]
    limits = np.array([np.quantile(entropy[truth == k, k], 1 - REJECT) if (truth == k).any() else np.inf for k in range(len(languages))])
    return model, float(factors[int(np.argmin(loss))]), limits


def languages(docs: DataFrame, chars: int = SAMPLE_CHARS, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, rejected); rows whose crc32 of the id leaves 2 by 4 are held out."""
    model, factor, limits = learned(docs.where(remainder("doc_id", 4) != 2), chars, order)
    shared = docs.sparkSession.sparkContext.broadcast((model, factor, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, factor, limits = shared.value
        for batch in batches:
            texts = batch.column("text")
            _, offsets = utf8(texts)
            for i, j in cuts(offsets):
                ids = batch.column("doc_id").slice(i, j - i)
                none = np.ones(j - i, bool)
                best, score, least = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                if model:
                    entropy, n = model.entropy(pc.utf8_lower(texts.slice(i, j - i)))
                    best, none = entropy.argmin(axis=1), n == 0
                    score = np.where(none, 0.0, _probability(entropy, n, factor).max(axis=1))
                    least = np.where(none, 0.0, entropy.min(axis=1))
                names = np.array([*(model.languages if model else []), "und"], object)
                named = np.where(none, len(names) - 1, best)
                rejected = none | (least > limits[best]) if model else none
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[named].tolist(), pa.string()), pa.array(score), pa.array(least), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"]
                )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")

"""Language-model scores by context-tree weighting.

The modelled string of a text is its words (runs of bytes other than ASCII
white space, A-Z in lower case) with one space between and an end byte; it
starts in the context of earlier end bytes.  A byte is eight binary choices,
and each choice has a context tree over the ``DEPTH`` bytes before.  A node
with counts a and b predicts by Krichevsky-Trofimov, (a+1/2)/(a+b+1), and its
weighted probability is half its own plus half the product of its children's.
The trained trees give a choice the mixture over all depths at which its
context was seen, which is a proper distribution.

Counts of (DEPTH+1)-byte grams cover all training texts; those of other texts
are listed with count 0.  They are summed per task, then by key, and dealt by
their last two context bytes, so that a task holds whole subtrees.  Only the
nodes where subtrees meet (at most 65,536 contexts of two bytes) pass the
driver, which makes the two levels above; each task then gives every distinct
gram of its subtrees its probability.  Nothing depends on the size of the input:
DEPTH is the same for all, and no task or broadcast holds the model.

The base score is that of single words with add-0.1 smoothing.  Words and grams
above a count threshold, picked so that at most ``MOST_FREQUENT`` and
``MOST_GRAMS`` are, are broadcast and summed with the text; the rarer ones of
each text are shuffled by key and joined with their values, so that every one
counts.

Cases: null texts are empty: one end token.  Without training rows N, V and the
counts are 0 and both scores use the smoothing alone (eight even choices a
byte).  Rows that repeat a doc_id are scored each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, WHITE, Lookup, U, Words, by_slice, cuts, lists, utf8
from .tables import durable, remainder

DEPTH = 5
MOST_GRAMS = 1 << 20
MOST_FREQUENT = 1 << 18
GRAMS_PER_TASK = 200_000
TASK_KEYS = 2_000_000
SMOOTHING = 0.1
PART = 1 << 20  # bytes looked at at once
END, SPACE = 10, 32


def modelled(data: np.ndarray, offsets: np.ndarray, words: Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places to predict, row of each place) of the modelled strings, each after ``depth`` end bytes."""
    rows = len(offsets) - 1
    length = words.end - words.start
    per_word = length + 1
    many = np.bincount(words.row, per_word, rows).astype(np.int64)
    size = np.maximum(many, 1)
    begin = np.cumsum(size + depth) - size  # first place of each row
    out = np.full(int((size + depth).sum()), END, np.uint8)
    before = np.cumsum(per_word) - per_word
    at = before - (np.cumsum(many) - many)[words.row] + begin[words.row]  # where each word starts
    shift = np.repeat(at - words.start, length)
    inside = np.flatnonzero(~WHITE[data])
    out[inside + shift] = LOWER[data[inside]]
    last = np.zeros(len(words.row), bool)
    last[words.first[1:][words.first[:-1] < words.first[1:]] - 1] = True
    out[(at + length)[~last]] = SPACE
    row = np.repeat(np.arange(rows), size)
    places = np.arange(len(row)) + (row + 1) * depth
    return out, places, row


def packed(codes: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The byte at each place in the low bits, the one before above it, and so on."""
    key = codes[places].astype(U)
    for j in range(1, depth + 1):
        key |= codes[places - j].astype(U) << U(8 * j)
    return key


_small = np.array([math.lgamma(x / 2) if x else 0.0 for x in range(4096)])


def _lgamma_half(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2): a table of small values, Stirling's series above."""
    x = np.maximum(twice, 4000) / 2.0
    large = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(twice < 4096, _small[np.minimum(twice, 4095)], large)


def block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block of zeros and ones."""
    return _lgamma_half(2 * zeros + 1) + _lgamma_half(2 * ones + 1) - math.log(math.pi) - _lgamma_half(2 * (zeros + ones) + 2)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def leaves(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and choice, zeros, ones) at full depth; a choice is the bits so far after a leading one."""
    symbol, context = grams & U(255), (grams >> U(8)) << U(8)
    keys, zeros, ones = [], [], []
    for b in range(8):
        bit = (symbol >> U(7 - b)) & U(1)
        keys.append(context | U(1 << b) | (symbol >> U(8 - b)))
        zeros.append(np.where(bit == 0, counts, 0))
        ones.append(np.where(bit == 1, counts, 0))
    return _grouped(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_weighted: np.ndarray | None, depth: int, stop: int):
    """Yields (depth, keys, zeros, ones, own share, log weighted probability) from ``depth`` up to ``stop``."""
    for d in range(depth, stop - 1, -1):
        own = block(zeros, ones)
        if log_weighted is None:  # leaves: their own estimate is all there is
            share, total = np.ones(len(keys)), own
        else:
            share = 1 / (1 + np.exp(np.clip(log_weighted - own, -60, 60)))
            total = np.logaddexp(own, log_weighted) - math.log(2)
        yield d, keys, zeros, ones, share, total
        if d > stop:
            up = (keys & U(255)) | (((keys >> U(8)) & U((1 << (8 * (d - 1))) - 1)) << U(8))
            keys, zeros, ones, log_weighted = _grouped(up, zeros, ones, total)


Nodes = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def log10(grams: np.ndarray, depth: int, nodes: Nodes) -> np.ndarray:
    """log10 of the probability of the low byte of each gram after the bytes above it.

    nodes[d]: sorted choices of contexts of d bytes, their chance of a one and the share of their own estimate.
    """
    total = np.zeros(len(grams))
    symbol = grams & U(255)
    for b in range(8):
        choice = U(1 << b) | (symbol >> U(8 - b))
        one = np.full(len(grams), 0.5)
        seen = np.zeros(len(grams), bool)
        for d in range(depth, -1, -1):
            keys, chance, share = nodes[d]
            wanted = (((grams >> U(8)) & U((1 << (8 * d)) - 1)) << U(8)) | choice
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[at] == wanted if len(keys) else seen & False
            at = at[hit]
            one[hit] = np.where(seen[hit], share[at] * chance[at] + (1 - share[at]) * one[hit], chance[at])
            seen |= hit
        total += np.log10(np.where((symbol >> U(7 - b)) & U(1) == 1, one, 1 - one))
    return total


def _counted(depth: int):
    """Distinct grams and words of a task with their counts in training texts: kind 0 grams, 1 words, 2 texts; grams of other texts have 0."""

    def merged(old: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = np.unique(keys, return_counts=True)
        return made if old is None else _grouped(np.concatenate([old[0], made[0]]), np.concatenate([old[1], made[1]]))

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not kind:  # the low bit says whether the text is a training text
            keys, n = _grouped(keys >> U(1), np.where(keys & U(1) == 1, n, 0))
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[i : i + 100_000].astype(np.int64))], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = words = None
        texts = 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            texts += int(train.sum())
            for i, j in cuts(offsets, PART):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = Words(own, off, WHITE, LOWER)
                codes, places, row = modelled(own, off, found, depth)
                grams = merged(grams, (packed(codes, places, depth) << U(1)) | train[i:j][row].astype(U))
                words = merged(words, found.hash[train[i:j][found.row]])
                if len(grams[0]) > TASK_KEYS:  # part sums, so a task's memory is bounded
                    yield from rows(0, *grams)
                    grams = None
                if len(words[0]) > TASK_KEYS:
                    yield from rows(1, *words)
                    words = None
        for kind, pair in ((0, grams), (1, words)):
            if pair is not None:
                yield from rows(kind, *pair)
        yield from rows(2, np.zeros(1, U), np.array([texts]))

    return run


def _parted(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column("key").to_numpy().view(U), b.column("n").to_numpy()) for b in batches if len(b)]
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])


def values(grams: DataFrame, depth: int) -> DataFrame:
    """(key, n, value) of grams(key, n): log10 of the probability of each gram's last byte, learned from the counts n."""
    stop = min(2, depth)
    above = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * stop)) - 1))
    tasks = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), grams.count() // GRAMS_PER_TASK + 1)
    dealt = durable(grams.repartition(tasks, F.xxhash64(above)))

    def built(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        return levels(*leaves(keys[n > 0], n[n > 0], depth), None, depth, stop)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, keys, zeros, ones, _, total in built(*_parted(batches)):
            if d == stop:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(total)], ["key", "zeros", "ones", "total"])

    upper: Nodes = {}
    if stop:
        # the subtrees meet above two bytes of context: at most 65,536 * 255 choices at any size of the input
        met = dealt.mapInArrow(tops, "key long, zeros long, ones long, total double").toArrow()
        keys, zeros, ones, total = (met.column(c).to_numpy() for c in ("key", "zeros", "ones", "total"))
        keys = keys.view(U)
        up = (keys & U(255)) | (((keys >> U(8)) & U((1 << (8 * (stop - 1))) - 1)) << U(8))
        for d, keys, zeros, ones, share, _ in levels(*_grouped(up, zeros, ones, total), stop - 1, 0):
            upper[d] = (keys, (ones + 0.5) / (zeros + ones + 1.0), share)
    shared = grams.sparkSession.sparkContext.broadcast(upper)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = _parted(batches)
        nodes = dict(shared.value)
        for d, keys, zeros, ones, share, _ in built(grams, n):
            nodes[d] = (keys, (ones + 0.5) / (zeros + ones + 1.0), share)
        for i in range(0, len(grams), 50_000):
            part = grams[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(n[i : i + 50_000]), pa.array(log10(part, depth, nodes))], ["key", "n", "value"])

    return durable(dealt.mapInArrow(valued, "key long, n long, value double"))


def _frequent(rows: DataFrame, most: int) -> tuple[int, list]:
    """The least power of two so that at most ``most`` rows(n) have that n or more, and (log2, rows, sum of n) of them by size."""
    sizes = sorted(rows.where("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect(), reverse=True)
    least, room = 62, most
    for r in sizes:
        room -= r["rows"]
        if room < 0:
            break
        least = r["b"]
    return 1 << least, sizes


def _sorted(rows: DataFrame, value: str) -> tuple[Lookup, np.ndarray]:
    """A lookup of the keys of rows and their values, both in the driver: for few rows only."""
    here = rows.select("key", value).toArrow()
    keys = here.column("key").to_numpy().view(U)
    order = np.argsort(keys)
    return Lookup(keys[order]), here.column(value).to_numpy()[order]


def _rare(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of each distinct hash of each row."""
    by = np.lexsort((hashes, row))
    hashes, row = hashes[by], row[by]
    heads = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return row[heads], hashes[heads], np.diff(np.append(heads, len(hashes)))


def scores(docs: DataFrame, depth: int = DEPTH, most_grams: int = MOST_GRAMS, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """Base and model scores of each row of docs(doc_id, text), with the code length in bits a modelled byte; rows whose crc32 of the id leaves 0 by 10 are held out."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flagged = texts.select("text", (remainder("doc_id", 10) != 0).alias("train"))
    counted = durable(flagged.mapInArrow(_counted(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counted.where("kind = 1").select("key", "n")
    threshold, sizes = _frequent(words, most_frequent)
    train_texts = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    total = sum(r["n"] for r in sizes) + train_texts
    distinct = sum(r["rows"] for r in sizes) + (train_texts > 0)
    valued = values(counted.where("kind = 0").select("key", "n"), depth)
    often, _ = _frequent(valued, most_grams)
    shared = context.broadcast((_sorted(words.where(F.col("n") >= threshold).withColumn("log", F.log10(F.col("n") + SMOOTHING)), "log"), _sorted(valued.where(F.col("n") >= often), "value")))
    end_log, norm = math.log10(train_texts + SMOOTHING), math.log10(total + SMOOTHING * (distinct + 1))

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        (known_words, logs), (known_grams, known_values) = shared.value
        rows = len(batch)
        found = Words(data, offsets, WHITE, LOWER)
        codes, places, row = modelled(data, offsets, found, depth)
        grams = packed(codes, places, depth)
        at, hit = known_grams.find(grams)
        score = np.bincount(row[hit], known_values[at[hit]], rows).astype(float) if len(known_values) else np.zeros(rows)
        rare = [(0, *_rare(grams[~hit], row[~hit]))]
        at, hit = known_words.find(found.hash)
        sums = np.bincount(found.row[hit], logs[at[hit]], rows).astype(float) if len(logs) else np.zeros(rows)
        rare.append((1, *_rare(found.hash[~hit], found.row[~hit])))
        kind = np.concatenate([np.full(len(r), k, np.int32) for k, r, _, _ in rare])
        own, key, times = (np.concatenate([x[i] for x in rare]) for i in (1, 2, 3))
        order = np.argsort(own, kind="stable")
        many = np.bincount(own, minlength=rows)
        return pa.RecordBatch.from_arrays(
            [batch.column("at"), batch.column("doc_id"), pa.array(np.bincount(found.row, minlength=rows) + 1), pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(found.row[hit], minlength=rows)), pa.array(sums), pa.array(score)]
            + [lists(kind[order], many, pa.int32()), lists(key[order].view(np.int64), many, pa.int64()), lists(times[order], many, pa.int64())],
            ["at", "doc_id", "n_tokens", "n_bytes", "frequent", "sums", "likely", "kind", "key", "times"],
        )

    parts = durable(
        texts.withColumn("at", F.monotonically_increasing_id()).select("at", "doc_id", "text").mapInArrow(
            lambda batches: by_slice(make, batches, size=PART),
            "at long, doc_id long, n_tokens long, n_bytes long, frequent long, sums double, likely double, kind array<int>, key array<long>, times array<long>",
        )
    )
    rarer = valued.where(F.col("n") < often).select(F.lit(0).alias("kind"), "key", "value")
    rarer = rarer.unionByName(words.where(F.col("n") < threshold).select(F.lit(1).alias("kind"), "key", F.log10(F.col("n") + SMOOTHING).alias("value")))
    rare = parts.select("at", F.inline(F.arrays_zip("kind", "key", "times"))).join(rarer, ["kind", "key"], "left")
    share = F.col("times") * F.coalesce("value", F.lit(math.log10(SMOOTHING)))
    rare = rare.groupBy("at").agg(
        F.sum(F.when(F.col("kind") == 1, share)).alias("word_sums"), F.sum(F.when((F.col("kind") == 1) & F.col("value").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.when(F.col("kind") == 0, share)).alias("gram_sums")
    )
    score = F.col("likely") + F.coalesce("gram_sums", F.lit(0.0))
    return parts.drop("kind", "key", "times").join(rare, "at", "left").select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens",
        (F.col("frequent") + F.coalesce("rare_known", F.lit(0)) + int(train_texts > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("word_sums", F.lit(0.0)) + end_log - F.col("n_tokens") * norm).alias("base_score"), score.alias("score"),
        "n_bytes", (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )

"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, ASCII letters in lower case.  A document
and a test item that share a seed of ``SHORTEST`` words are compared: the
longest common runs of unmarked words, found by running Karp-Rabin hashes of a
falling window length, are marked one after the other on both sides until none
of SHORTEST words is left.  Tiles may stand in any order, so a passage whose
sentences were moved about is still covered.  The item leaks into the document
if its tiles cover at least ``COVERAGE`` of its words.

The test items are read in blocks of at most ``BLOCK_CHARS`` characters (or one
item); each block is broadcast and all documents are scanned against it, so
what is broadcast is bounded whatever the size of the benchmark.

Cases: null texts are empty; an item of fewer than SHORTEST words can't leak
and a document of fewer can't hold a leak.  Rows that repeat an id are compared
one by one.  No items or no documents: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, MARKS, Words, cuts, utf8

SHORTEST = 4
COVERAGE = 0.6
BLOCK_CHARS = 8_000_000
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _windows(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of each run of ``size`` unmarked words."""
    drop, have, value = pow(_BASE, size, _MOD), 0, 0
    for i, w in enumerate(words):
        if marked[i]:
            have = value = 0
            continue
        value = (value * _BASE + w) % _MOD
        have += 1
        if have > size:
            value = (value - words[i - size] * drop) % _MOD
        if have >= size:
            yield i - size + 1, value


def tiles(item: list[int], text: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the tiles, longest first."""
    marked_i, marked_t, found = [False] * len(item), [False] * len(text), []

    def reach(p: int, t: int, most: int) -> int:
        n = 0
        while n < most and p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not marked_i[p + n] and not marked_t[t + n]:
            n += 1
        return n

    size = max(shortest, len(item) // 2)
    while len(item) >= shortest:
        table = defaultdict(list)
        for p, h in _windows(item, marked_i, size):
            table[h].append(p)
        heap = []
        for t, h in _windows(text, marked_t, size):
            for p in table.get(h, ()):
                # only from the left end of a common run
                left = p and t and item[p - 1] == text[t - 1] and not marked_i[p - 1] and not marked_t[t - 1]
                if not left and (n := reach(p, t, len(item))) >= size:
                    heap.append((-n, p, t))
        heapify(heap)
        while heap:
            n, p, t = heappop(heap)
            n = -n
            now = reach(p, t, n)
            if now == n:
                for k in range(n):
                    marked_i[p + k] = marked_t[t + k] = True
                found.append((p, t, n))
                continue
            # another tile took some of it: what is left on either side stays a candidate
            if now >= size:
                heappush(heap, (-now, p, t))
            k = now
            while k < n:
                while k < n and (marked_i[p + k] or marked_t[t + k]):
                    k += 1
                part = reach(p + k, t + k, n - k)
                if part >= size:
                    heappush(heap, (-part, p + k, t + k))
                k += max(part, 1)
        if size == shortest:
            break
        size = max(shortest, size // 2)
    return found


class _Items:
    """The words of some test items and where their seeds are."""

    def __init__(self, ids: list, texts: list[str], shortest: int):
        words = Words(*utf8(pa.array(texts, pa.string())), MARKS, LOWER)
        self.ids = ids
        self.words = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        at, seeds = words.shingles(shortest)
        row = words.row[at]
        long = np.diff(words.first)[row] >= shortest
        pairs = np.unique(np.stack([seeds[long], row[long].astype(np.uint64)], 1), axis=0) if long.any() else np.zeros((0, 2), np.uint64)
        self.seeds, self.start = np.unique(pairs[:, 0], return_index=True)
        self.start = np.append(self.start, len(pairs))
        self.item = pairs[:, 1].astype(np.int64)


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("covered", pa.int32()), ("tiles", pa.list_(pa.list_(pa.int32())))])


def _scan(shared, shortest: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in cuts(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], MARKS, LOWER)
                at, seeds = words.shingles(shortest)
                if not len(items.seeds) or not len(at):
                    continue
                place = np.minimum(np.searchsorted(items.seeds, seeds), len(items.seeds) - 1)
                hit = items.seeds[place] == seeds
                at, place = at[hit], place[hit]
                if not len(at):
                    continue
                # every (hit, item of its seed)
                many = items.start[place + 1] - items.start[place]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                item, at = items.item[np.repeat(items.start[place], many) + step], np.repeat(at, many)
                key = words.row[at] * len(items.ids) + item
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                out = []
                for s, e in zip(heads, np.append(heads[1:], len(key)), strict=True):
                    row, which = divmod(int(key[s]), len(items.ids))
                    own = items.words[which]
                    if shortest * (e - s) < coverage * len(own):
                        continue  # so few seeds can't cover enough
                    first, last = words.first[row], words.first[row + 1]
                    near = np.zeros(last - first, bool)
                    for t in at[s:e] - first:
                        near[max(0, t - len(own)) : t + len(own) + shortest] = True
                    spots = np.flatnonzero(near)
                    text, where, before = [], [], -1
                    for x in spots.tolist():
                        if x != before + 1 and text:
                            text.append(-1)  # no word: runs end here
                            where.append(-1)
                        text.append(int(words.hash[first + x]))
                        where.append(x)
                        before = x
                    made = tiles([int(x) for x in own], text, shortest)
                    covered = sum(n for _, _, n in made)
                    if covered >= coverage * len(own):
                        out.append((i + row, items.ids[which], len(own), covered, [[p, where[t], n] for p, t, n in sorted(made)]))
                if out:
                    ids = batch.column("doc_id").take(pa.array([x[0] for x in out]))
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *[pa.array([x[k] for x in out], _OUT.field(k).type) for k in range(1, 5)]], schema=_OUT)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, covered, coverage, tiles) of each item that leaks into a document.

    tiles: lists of first word in the item, first word in the document, words.
    """
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(_Items([r[0] for r in rows], [r[1] for r in rows], shortest))
        part = texts.mapInArrow(_scan(shared, shortest, coverage), "doc_id long, item_id long, n_words int, covered int, tiles array<array<int>>")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("coverage", F.col("covered") / F.col("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no leak; rows with a null id stay only if no such row holds one."""
    bad = leaks(docs, benchmark, **options).select("doc_id").distinct()
    # each side through its alias: docs may have any other columns
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
